"""Per-line rules over configuration texts (L0-L18), as expressions and joins: one plan for all configs.

``mode="reference"`` keeps the quirks of the rule set it reproduces (section headers need a name, ports of
five digits and first octets from 250 are refused, options that name a log or forwarding feature count as
typos, only ``backend`` sections define backends); ``mode="strict"`` corrects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the configuration language.
BALANCE = ("roundrobin", "static-rr", "leastconn", "first", "source", "uri", "url_param", "hdr", "rdp-cookie", "random")
TIMEOUTS = ("connect", "client", "server", "http-keep-alive", "http-request", "queue", "tunnel", "check")
MODES = ("http", "tcp", "health")
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
TYPOS = (("optoin", "option"), ("opton", "option"), ("httplog", "httplog"), ("tcplog", "tcplog"), ("forwardfor", "forwardfor"))
STRICT_TYPOS = TYPOS[:2]

SECTION = r"^\s*(global|defaults|frontend|backend|listen|userlist)\s+(\S+)"
STRICT_SECTION = r"^\s*(global|defaults|frontend|backend|listen|userlist)(?:\s+(\S+))?\s*$"
BIND = r"^\s*bind\s+([^\s:]+):(\d+)(?:\s+(.*))?$"
SERVER = r"^\s*server\s+(\S+)\s+([^\s:]+):(\d+)(?:\s+(.*))?$"
OPTION = r"^\s*option\s+(\S+)(?:\s+(.*))?$"
TIMEOUT = r"^\s*timeout\s+(\S+)\s+(\d+)(?:\s*(ms|s|m|h|d))?$"
ACL = r"^\s*acl\s+(\S+)\s+(\S+)\s+(.+)$"
USE = r"^\s*use_backend\s+(\S+)(?:\s+(.*))?$"
DEFAULT = r"^\s*default_backend\s+(\S+)$"
BALANCE_LINE = r"^\s*balance\s+(\S+)(?:\s+(.*))?$"
MODE_LINE = r"^\s*mode\s+(\S+)\s*$"
STATS = r"^\s*stats\s+(enable|uri)(?:\s+(.*))?$"
LONG_PORT = r":(\d{5,})\b"
NEGATIVE = r"timeout\s+\S+\s+-\d+"
BAD_OCTET = r"\b(2[5-9][0-9]|3[0-9][0-9]|[4-9][0-9][0-9])\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
STRICT_OCTET = r"\b(25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def lines(configs: DataFrame) -> DataFrame:
    """config_id, line (from 1), text: without blank lines and comments (L1)."""
    rows = configs.select("config_id", F.posexplode(F.split(F.coalesce("config", F.lit("")), "\n")).alias("pos", "text"))
    return rows.withColumn("line", F.col("pos") + 1).drop("pos").filter(~F.col("text").rlike(r"^\s*(#.*)?$"))


def sections(rows: DataFrame, mode: str = "reference") -> DataFrame:
    """Adds section and section_name in force on each line (L2)."""
    p = SECTION if mode == "reference" else STRICT_SECTION
    w = Window.partitionBy("config_id").orderBy("line")
    head = F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    marked = rows.withColumn("header", head).withColumn("header_name", F.when(head.isNotNull(), F.regexp_extract("text", p, 2)))
    return marked.withColumn("section", F.last("header", ignorenulls=True).over(w)).withColumn("section_name", F.last("header_name", ignorenulls=True).over(w))


def findings(configs: DataFrame, mode: str = "reference") -> DataFrame:
    """config_id, line, rule, error_type, severity, value of every finding.

    All line rules are one projection: an array of nullable findings per line, exploded once.
    """
    strict = mode == "strict"
    rows = sections(lines(configs), mode)
    text = F.col("text")
    got = lambda p, i: F.regexp_extract(text, p, i)
    is_ = lambda p: text.rlike(p)
    server = F.when(is_(SERVER), got(SERVER, 1))
    scope = ["config_id", "section_name"] if strict else ["config_id"]
    repeat = F.row_number().over(Window.partitionBy(*scope, server).orderBy("line"))
    rows = rows.withColumn("_server", server).withColumn("_repeat", F.when(server.isNotNull(), repeat))

    def finding(when: Column, rule: str, kind: str, severity: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"), value.cast("string").alias("value")))

    def port(p: str, i: int) -> Column:
        return F.coalesce(got(p, i).try_cast("long"), F.lit(1 << 40)).between(1, 65535)

    unverified = lambda p, i: is_(p) & got(p, i).contains("ssl") & got(p, i).contains("verify none")
    unit = F.coalesce(F.nullif(got(TIMEOUT, 3), F.lit("")), F.lit("s"))
    factor = F.lit(1000)
    for name, ms in UNIT_MS.items():
        factor = F.when(unit == name, ms).otherwise(factor)
    typo = None
    for wrong, _ in STRICT_TYPOS if strict else TYPOS:
        hit = F.lower(got(OPTION, 1)).contains(wrong)
        typo = F.when(hit, wrong) if typo is None else typo.when(hit, wrong)
    long_port = is_(LONG_PORT) & (F.coalesce(got(LONG_PORT, 1).try_cast("long"), F.lit(1 << 40)) > 65535 if strict else F.lit(True))
    octet = STRICT_OCTET if strict else BAD_OCTET
    rules = [
        finding(F.col("header").isNotNull(), "section", "syntax", "info", F.concat_ws(" ", "header", "header_name")),
        finding(is_(BIND) & ~port(BIND, 2), "bind_port", "syntax", "error", got(BIND, 2)),
        finding(unverified(BIND, 3), "bind_verify_none", "security", "warning", got(BIND, 1)),
        finding(is_(SERVER) & ~port(SERVER, 3), "server_port", "syntax", "error", got(SERVER, 3)),
        finding(F.col("_repeat") > 1, "server_repeated", "logic", "error", F.col("_server")),
        finding(unverified(SERVER, 4), "server_verify_none", "security", "warning", got(SERVER, 1)),
        finding(is_(TIMEOUT) & ~got(TIMEOUT, 1).isin(*TIMEOUTS), "timeout_type", "syntax", "error", got(TIMEOUT, 1)),
        finding(is_(TIMEOUT) & (got(TIMEOUT, 2).try_cast("double") * factor > 3_600_000), "timeout_long", "logic", "warning", got(TIMEOUT, 2)),
        finding(is_(ACL) & (got(ACL, 2) == "src") & got(ACL, 3).contains("0.0.0.0/0"), "acl_permissive", "security", "warning", got(ACL, 1)),
        finding(is_(BALANCE_LINE) & ~got(BALANCE_LINE, 1).isin(*BALANCE), "balance", "syntax", "error", got(BALANCE_LINE, 1)),
        finding(is_(STATS), "stats_no_auth", "security", "warning", got(STATS, 1)),
        finding(is_(OPTION) & typo.isNotNull(), "option_typo", "syntax", "error", typo),
        finding(long_port, "port_digits", "syntax", "error", got(LONG_PORT, 1)),
        finding(is_(NEGATIVE), "timeout_negative", "logic", "error", F.lit(None)),
        finding(is_(octet), "ip", "syntax", "error", got(octet, 1)),
    ]
    if strict:
        rules.append(finding(is_(MODE_LINE) & ~got(MODE_LINE, 1).isin(*MODES), "mode", "syntax", "error", got(MODE_LINE, 1)))
    # A header line is taken as such and checked by no other rule.
    every = F.array_compact(F.array(*[rules[0], *(F.when(F.col("header").isNull(), r) for r in rules[1:])]))
    by_line = rows.select("config_id", "line", F.explode(every).alias("f")).select("config_id", "line", "f.*")
    return by_line.unionByName(_references(rows, strict))


def _references(rows: DataFrame, strict: bool) -> DataFrame:
    """Backends that are used but not defined, and in strict mode ACLs."""
    text = F.col("text")
    body = rows.filter("header is null")
    used = body.select("config_id", F.coalesce(F.nullif(F.regexp_extract(text, USE, 1), F.lit("")), F.nullif(F.regexp_extract(text, DEFAULT, 1), F.lit(""))).alias("value")).filter("value is not null").distinct()
    defined = rows.filter(F.col("header").isin("backend", "listen") if strict else F.col("header") == "backend").select("config_id", F.col("header_name").alias("value"))
    out = used.join(defined, ["config_id", "value"], "left_anti").select("config_id", F.lit(0).alias("line"), F.lit("backend_undefined").alias("rule"), F.lit("reference").alias("error_type"), F.lit("error").alias("severity"), "value")
    if strict:
        names = F.explode(F.filter(F.split(F.regexp_extract(text, r"\b(?:if|unless)\s+(.*)$", 1), r"\s+|!"), lambda x: x.rlike("^[A-Za-z_]")))
        acls = body.filter(text.rlike(r"\b(if|unless)\s")).select("config_id", names.alias("value")).filter(~F.col("value").isin("or", "TRUE", "FALSE")).distinct()
        known = body.select("config_id", F.regexp_extract(text, ACL, 1).alias("value"))
        out = out.unionByName(acls.join(known, ["config_id", "value"], "left_anti").select("config_id", F.lit(0).alias("line"), F.lit("acl_undefined").alias("rule"), F.lit("reference").alias("error_type"), F.lit("warning").alias("severity"), "value"))
    return out


def summary(configs: DataFrame, found: DataFrame) -> DataFrame:
    """errors, warnings, compliance = clamp(1 - 0.1 E - 0.02 W) and a label per config."""
    n = found.groupBy("config_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = configs.select("config_id").join(n, "config_id", "left").na.fill(0, ["errors", "warnings"])
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.1 * F.col("errors") - 0.02 * F.col("warnings"))), 6)
    label = F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")
    return rows.withColumn("compliance", score).withColumn("label", label)


def tool(configs: DataFrame) -> DataFrame:
    """config_id, message: what an agent is told of each configuration; a null one is an error of its own, not of the job."""
    there = configs.filter("config is not null")
    n = summary(there, findings(there))
    counts = F.when(F.col("errors") > 0, F.format_string("invalid: %d errors, %d warnings", "errors", "warnings")).otherwise(F.format_string("valid: %d warnings", "warnings"))
    return n.select("config_id", counts.alias("message")).unionByName(configs.filter("config is null").select("config_id", F.lit("error: no configuration").alias("message")))
