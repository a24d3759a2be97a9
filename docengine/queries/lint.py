"""The linter over configurations made from driver rows: a hash of doc_id chooses which of the lines below each has."""

from pyspark.sql import functions as F

from docengine.operators import lint as L
from docengine.registry import query, table

#: Every line, with the findings (rule, value) it gives in reference mode, and those of strict mode where they differ.
_LINES = (
    ("  bind *:80", (), None),
    ("  bind *:70000", (("bind_port", "70000"), ("port_digits", "70000")), None),
    ("  bind *:443 ssl verify none", (("bind_verify_none", "*"),), None),
    ("  server s1 10.0.0.1:80", (), None),
    ("  server s1 10.0.0.2:0 check", (("server_port", "0"),), None),
    ("  server s2 10.0.0.3:8080 ssl verify none", (("server_verify_none", "s2"),), None),
    ("  timeout foo 5s", (("timeout_type", "foo"),), None),
    ("  timeout connect 2h", (("timeout_long", "2"),), None),
    ("  timeout client 30s", (), None),
    ("  acl ok src 0.0.0.0/0", (("acl_permissive", "ok"),), None),
    ("  balance fastest", (("balance", "fastest"),), None),
    ("  stats enable", (("stats_no_auth", "enable"),), None),
    ("  option optoins", (("option_typo", "optoin"),), None),
    ("  timeout server -5", (("timeout_negative", None),), None),
    ("  server s3 256.1.1.1:80", (("ip", "256"),), None),
    ("# bind *:70000", (), None),
    ("", (), None),
    ("  option httplog", (("option_typo", "httplog"),), ()),
    ("  server s4 252.1.1.1:12345", (("port_digits", "12345"), ("ip", "252")), ()),
    ("  mode foo", (), (("mode", "foo"),)),
    ("  use_backend app", (), None),
    ("  use_backend app if is_x", (), None),
    ("  acl is_x path /x", (), None),
    ("  default_backend other", (), None),
    ("backend app", (("section", "backend app"),), None),
    ("  balance roundrobin", (), None),
    ("listen other", (("section", "listen other"),), None),
)
_ERRORS = ("bind_port", "server_port", "server_repeated", "timeout_type", "balance", "option_typo", "port_digits", "timeout_negative", "ip", "mode", "backend_undefined")
_WARNINGS = ("bind_verify_none", "server_verify_none", "timeout_long", "acl_permissive", "stats_no_auth", "acl_undefined")


def _bit(i: int) -> str:
    return f"((doc_id * 2654435761) >> {i}) & 1 = 1"


def configs(spark, sf):
    lines = F.array_compact(F.array(*[F.when(F.expr(_bit(i)), F.lit(text)) for i, (text, _, _) in enumerate(_LINES)]))
    config = F.concat(F.lit("frontend web\n"), F.array_join(lines, "\n"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("config_id"), config.alias("config"))


def _found(strict: bool = False) -> str:
    """SQL: c (configs), n (their lines, numbered) and f (config_id, line, rule, value)."""
    at = {text: i for i, (text, _, _) in enumerate(_LINES)}
    given = [(i, rule, value) for i, (_, own, other) in enumerate(_LINES) for rule, value in (other if strict and other is not None else own)]
    rules = ", ".join(f"({i}, '{rule}', {'NULL' if value is None else repr(value)})" for i, rule, value in given)
    lines = ", ".join(f"({i}, '{text}')" for i, (text, _, _) in enumerate(_LINES))
    chosen = "CASE i " + " ".join(f"WHEN {i} THEN {_bit(i)}" for i in range(len(_LINES))) + " END"
    has = lambda text: _bit(at[text]).replace("doc_id", "config_id")
    uses = f"({has('  use_backend app')} OR {has('  use_backend app if is_x')})"
    other_defined = f" AND NOT ({has('listen other')})" if strict else ""
    acl = f"UNION ALL SELECT config_id, 0, 'acl_undefined', 'is_x' FROM c WHERE {has('  use_backend app if is_x')} AND NOT ({has('  acl is_x path /x')})" if strict else ""
    return f"""k(i, line_text) AS (VALUES {lines}), u(i, rule, value) AS (VALUES {rules}), c AS (SELECT doc_id AS config_id FROM documents),
n AS (SELECT doc_id AS config_id, i, line_text AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) + 1)::INT AS line FROM documents, k WHERE {chosen}),
f AS (SELECT config_id, 1 AS line, 'section' AS rule, 'frontend web' AS value FROM c UNION ALL SELECT config_id, line, rule, value FROM n JOIN u USING (i)
UNION ALL SELECT config_id, line, 'server_repeated', 's1' FROM n WHERE i = {at['  server s1 10.0.0.2:0 check']} AND {has('  server s1 10.0.0.1:80')}
UNION ALL SELECT config_id, 0, 'backend_undefined', 'app' FROM c WHERE {uses} AND NOT ({has('backend app')})
UNION ALL SELECT config_id, 0, 'backend_undefined', 'other' FROM c WHERE {has('  default_backend other')}{other_defined} {acl})"""


_COUNTS = f"""n2 AS (SELECT config_id, count(*) FILTER (WHERE rule IN {_ERRORS})::BIGINT AS errors, count(*) FILTER (WHERE rule IN {_WARNINGS})::BIGINT AS warnings FROM f GROUP BY 1),
s AS (SELECT *, round(greatest(0, least(1, 1 - 0.1::DOUBLE * errors - 0.02::DOUBLE * warnings)), 6) AS compliance FROM n2)"""


@query("l0_findings", f"WITH {_found()} SELECT config_id, line, rule, value FROM f")
def findings(spark, sf):
    return L.findings(configs(spark, sf)).select("config_id", "line", "rule", "value")


@query("l16_compliance", f"WITH {_found()}, {_COUNTS} SELECT config_id, errors, warnings, compliance, CASE WHEN compliance >= 0.9 THEN 'excellent' WHEN compliance >= 0.7 THEN 'good' WHEN compliance >= 0.5 THEN 'fair' ELSE 'poor' END AS label FROM s")
def compliance(spark, sf):
    c = configs(spark, sf)
    return L.summary(c, L.findings(c))


@query("l2_sections", f"""WITH {_found()}, m AS (SELECT config_id, 1 AS line, 'frontend web' AS text FROM c UNION ALL SELECT config_id, line, text FROM n WHERE trim(text) <> '' AND NOT starts_with(text, '#')),
s AS (SELECT *, last_value(CASE WHEN text IN ('frontend web', 'backend app', 'listen other') THEN text END IGNORE NULLS) OVER (PARTITION BY config_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS head FROM m)
SELECT config_id, string_split(head, ' ')[1] AS section, string_split(head, ' ')[2] AS section_name, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def sections(spark, sf):
    return L.sections(L.lines(configs(spark, sf))).groupBy("config_id", "section", "section_name").agg(F.count("*").alias("n"))


@query("l14_references", f"WITH {_found()} SELECT config_id, value FROM f WHERE rule = 'backend_undefined'")
def references(spark, sf):
    return L.findings(configs(spark, sf)).filter("rule = 'backend_undefined'").select("config_id", "value")


@query("l_strict", f"WITH {_found(True)} SELECT config_id, line, rule, value FROM f")
def strict(spark, sf):
    return L.findings(configs(spark, sf), mode="strict").select("config_id", "line", "rule", "value")


@query("l18_tool", f"WITH {_found()}, {_COUNTS} SELECT config_id, CASE WHEN config_id % 7 = 0 THEN 'error: no configuration' WHEN errors > 0 THEN 'invalid: ' || errors || ' errors, ' || warnings || ' warnings' ELSE 'valid: ' || warnings || ' warnings' END AS message FROM s")
def tool(spark, sf):
    """A message for each configuration, also for the missing ones."""
    c = configs(spark, sf)
    return L.tool(c.select("config_id", F.when(F.col("config_id") % 7 != 0, F.col("config")).alias("config")))
