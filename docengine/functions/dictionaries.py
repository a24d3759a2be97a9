"""Lookup dictionaries. Results depend on these words and on their order."""

from __future__ import annotations

STOPWORDS = ("le", "la", "les", "de", "du", "des", "un", "une", "et", "ou", "en", "au", "aux", "the", "a", "an", "is", "are", "for", "in", "on", "at", "to", "of", "with", "by", "from", "this", "that")

TAG_KEYWORDS = {
    "stick-table": ["stick-table", "stick", "track-sc", "track-sc0", "track-sc1", "track-sc2", "gpc", "conn_rate", "conn_cur", "http_req_rate", "http_req_cnt"],
    "acl": ["acl", "path_beg", "path_end", "hdr", "host", "url", "src", "dst"],
    "healthcheck": ["check", "option httpchk", "http-check", "inter", "fall", "rise", "port"],
    "bind": ["bind", "ssl", "crt", "key", "cafile", "verify", "alpn", "proto"],
    "backend": ["backend", "server", "balance", "dispatch", "option"],
    "frontend": ["frontend", "default_backend", "use_backend"],
    "timeout": ["timeout", "connect", "client", "server", "http-request", "queue"],
    "logging": ["log", "syslog", "format", "capture", "error"],
    "ssl": ["ssl", "tls", "certificate", "cafile", "verify", "ciphers", "sni"],
    "compression": ["compression", "gzip", "deflate", "offload"],
    "rate_limit": ["rate", "limit", "throttle", "deny", "tarpit", "reject", "maxconn", "bandwidth"],
}

#: Each gives a tag directive:... where it is contained.
HTTP_REQUEST_ACTIONS = (
    "http-request deny",
    "http-request redirect",
    "http-request set-header",
    "http-request track-sc",
    "http-request track-sc0",
    "http-request track-sc1",
    "http-request set-bandwidth-limit",
    "http-request auth",
)

#: What a contained phrase adds to a query.
QUERY_EXPANSIONS = {
    "health check": ["health check", "check", "option httpchk", "tcp-check", "inter", "fall", "rise"],
    "httpchk": ["option httpchk", "http-check", "GET", "HEAD", "uri"],
    "bind": ["bind", "port", "ssl", "crt", "key", "cafile", "verify"],
    "rate limit": ["stick-table", "rate", "limit", "deny", "http_req_rate", "conn_rate", "conn_cur", "track-sc", "track-sc0", "track-sc1", "track-sc2"],
    "stick-table": ["stick-table", "stick table", "stick", "store", "store-request", "store-response", "track-sc", "http_req_rate", "conn_rate", "conn_cur", "gpc0", "gpc1", "server_id"],
    "stick": ["stick-table", "stick table", "store-request", "store-response", "track-sc", "on", "match"],
    "rate": ["stick-table", "rate", "limit", "http_req_rate", "conn_rate", "sess_rate", "exp", "expire"],
    "limit": ["stick-table", "limit", "rate", "deny", "tarpit", "throttle"],
    "conn_rate": ["stick-table", "conn_rate", "conn_cur", "connection rate", "track-sc", "deny"],
    "tracker": ["stick-table", "track-sc", "track-sc0", "stick on"],
    "acl": ["acl", "path_beg", "path_end", "hdr", "host", "url", "use_backend", "if", "path_reg", "path_sub", "path"],
    "access control": ["acl", "condition", "filter", "path_beg", "hdr", "deny"],
    "regex": ["acl", "regex", "regexp", "path_reg", "hdr_reg", "url_reg", "pattern"],
    "negation": ["acl", "!", "not", "negation", "negated", "unless"],
    "timeout": ["timeout", "connect", "client", "server", "http-request", "queue"],
    "ssl": ["ssl", "tls", "crt", "certificate", "cafile", "verify", "ciphers", "ca-file", "crl-file", "verify required", "verify none"],
    "tls": ["ssl", "tls", "certificate", "crt", "cafile", "verify"],
    "certificate": ["ssl", "crt", "certificate", "cafile", "pem", "chain"],
    "cafile": ["ssl", "cafile", "ca-file", "CA certificate", "verify"],
    "verify": ["ssl", "verify", "cafile", "verify required", "verify none", "client certificate"],
    "stats": ["stats", "statistics", "monitoring", "show", "hide", "uri", "admin", "socket"],
    "statistics": ["stats", "statistics", "monitoring", "table", "show"],
    "monitoring": ["stats", "monitoring", "health", "status", "show"],
    "map": ["map", "converters", "convert", "lower", "upper", "table", "file"],
    "converter": ["converters", "convert", "map", "lower", "upper", "str", "int", "ipmask"],
    "lower": ["converters", "lower", "lc", "lowercase", "string"],
    "upper": ["converters", "upper", "uc", "uppercase", "string"],
}

#: What a query that contains "http" adds.
HTTP_EXPANSIONS = ("HTTP", "http-request", "http-response", "httpchk")

SECTION_HINTS = {
    "stick-table": ["11.1", "11.2", "7.3"],
    "acl": ["7.1", "7.2", "7.3", "7.4"],
    "bind": ["4.2", "5.1", "5.3"],
    "backend": ["5.1", "5.2", "5.3"],
    "server": ["5.2", "5.3"],
    "timeout": ["4.2", "5.2", "5.3"],
    "health": ["5.2", "5.3"],
    "check": ["5.2", "5.3"],
    "ssl": ["4.2", "5.1", "5.3"],
    "balance": ["5.1", "5.2"],
}

#: The first contained keyword, in this order, gives the category.
CATEGORY_HINTS = {
    "backend": "backend",
    "server": "backend",
    "serveur": "backend",
    "désactiver": "backend",
    "desactiver": "backend",
    "disable": "backend",
    "disabled": "backend",
    "down": "backend",
    "inactive": "backend",
    "backup": "backend",
    "weight": "backend",
    "balance": "loadbalancing",
    "roundrobin": "loadbalancing",
    "leastconn": "loadbalancing",
    "source": "loadbalancing",
    "load balancing": "loadbalancing",
    "loadbalancing": "loadbalancing",
    "acl": "acl",
    "access control": "acl",
    "condition": "acl",
    "filter": "acl",
    "stick-table": "stick-table",
    "stick table": "stick-table",
    "stick": "stick-table",
    "rate limit": "stick-table",
    "rate": "stick-table",
    "limit": "stick-table",
    "track": "stick-table",
    "track-sc": "stick-table",
    "conn_rate": "stick-table",
    "conn_cur": "stick-table",
    "http_req_rate": "stick-table",
    "store": "stick-table",
    "store-request": "stick-table",
    "store-response": "stick-table",
    "gpc": "stick-table",
    "server_id": "stick-table",
    "expire": "stick-table",
    "exp": "stick-table",
    "table": "stick-table",
    "bind": "frontend",
    "frontend": "frontend",
    "listen": "frontend",
    "timeout": "timeout",
    "delai": "timeout",
    "délai": "timeout",
    "health": "healthcheck",
    "healthcheck": "healthcheck",
    "check": "healthcheck",
    "httpchk": "healthcheck",
    "tcp-check": "healthcheck",
    "ssl": "ssl",
    "tls": "ssl",
    "certificate": "ssl",
    "certificat": "ssl",
    "crt": "ssl",
    "cafile": "ssl",
    "ca-file": "ssl",
    "verify": "ssl",
    "crl": "ssl",
    "crl-file": "ssl",
    "ciphers": "ssl",
    "client certificate": "ssl",
    "verify required": "ssl",
    "verify none": "ssl",
    "sni": "ssl",
    "alpn": "ssl",
    "log": "logs",
    "logs": "logs",
    "logging": "logs",
    "syslog": "logs",
    "stats": "stats",
    "statistics": "stats",
    "monitoring": "stats",
    "surveillance": "stats",
    "show": "stats",
    "hide": "stats",
    "socket": "stats",
    "uri": "stats",
    "admin": "stats",
    "map": "advanced",
    "maps": "advanced",
    "converter": "advanced",
    "converters": "advanced",
    "convert": "advanced",
    "lower": "advanced",
    "upper": "advanced",
    "lowercase": "advanced",
    "uppercase": "advanced",
    "lc": "advanced",
    "uc": "advanced",
}

#: (hint, category, weight): a related category counts 0.9, a general one 0.6.
RELATED = [("backend", "loadbalancing", 0.9), ("loadbalancing", "backend", 0.9), ("ssl", "frontend", 0.9), ("frontend", "ssl", 0.9), ("healthcheck", "loadbalancing", 0.9)]
GENERAL_CATEGORY = "acl"

STRONG_TITLE_WORDS = ("stick-table", "track-sc", "http_req_rate", "conn_rate", "deny", "acl")

QUERY_PATTERNS = (("script tags", r"(?is)<script[^>]*>.*?</script>"), ("javascript protocol", r"(?is)javascript:"), ("template injection", r"(?is)\{\{.*\}\}"), ("HTML tags", r"(?is)<[^>]*>"))
SOURCE_PATTERNS = (r"\$where", r"\$ne", r"\$gt|\$lt|\$gte|\$lte", r"\$in|\$nin", r"\$or|\$and|\$not", r"\$regex|\$expr", r"__proto__|__defineGetter__|constructor", r"eval\(|Function\(", r"<script[^>]*>", r"javascript:")
FALLBACK_PHRASES = ("je ne sais pas", "je n'ai pas trouvé", "information non disponible", "pas d'information", "désolé", "i don't know", "i couldn't find", "not available")
DOMAIN_TERMS = ("backend", "frontend", "server", "bind", "config", "section", "directive", "option", "check")
