"""Scalar functions of the ledger as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ledger's formats.
OID_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
GENESIS = "20b79ab70d6c1b43eaa927d0f8b1ede13353e43a450ae9ef9376eaba2231e0ab"
STATUSES = ("draft", "review", "approved", "canonical", "superseded", "archived", "deprecated", "active", "quarantined")
# Operation names and their token estimates. "{tool}" stands for the name under which the tool server is registered.
#: Estimates that do not look at the payload.
FLAT_ESTIMATES = {
    "get_lineage": 30,
    "mcp_get_lineage": 30,
    "detect_contradictions": 50,
    "mcp_detect_contradictions": 50,
    "get_impact": 30,
    "mcp_get_impact": 30,
    "checkpoint_save": 50,
    "mcp_checkpoint_save": 50,
    "checkpoint_restore": 20,
    "handoff": 40,
}
#: Surcharges of the conservative estimate.
SURCHARGES = {
    "mcp.{tool}.propose_decision": 500,
    "api.propose_decision": 500,
    "mcp.{tool}.query": 300,
    "api.query": 300,
    "mcp.{tool}.detect_contradictions": 800,
    "agent.checkpoint": 400,
}
TOOL = "ledger"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def json_safe(struct: Column) -> Column:
    """JSON of a struct with <, >, & and the two line separators escaped, and control characters in lower-case hex."""
    out = F.to_json(struct)
    for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # only where an even number of backslashes stands before: else it is text that looks like an escape
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return out


def leaf_hash(id: Column, title: Column, status: Column, domain: Column, system: Column, owner: Column, evidence_ids: Column | None = None) -> Column:
    """SHA-256 of a decision's JSON with sorted keys (X01). ``evidence_ids`` is an array of hex strings; nulls count as ''."""
    joined = F.lit("") if evidence_ids is None else F.coalesce(F.array_join(evidence_ids, ","), F.lit(""))
    fields = {"evidence_ids": joined, "id": id, "owner": owner, "scope_domain": domain, "scope_system": system, "status": status, "title": title}
    return F.sha2(json_safe(F.struct(*[_text(v).alias(k) for k, v in sorted(fields.items())])), 256)


def chain_hash(parent: Column, leaf: Column) -> Column:
    return F.sha2(F.concat(_text(parent), _text(leaf)), 256)


def snapshot_hash(tenant: Column, root: Column, height: Column, parent: Column, epoch: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[_text(x) for x in (tenant, root, height, parent, epoch)]), 256)


def evidence_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def uuid_v5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 over namespace and name, version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_text(name), "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def anonymize(id: Column, salt: str) -> Column:
    """The first 8 bytes of SHA-256 over id and salt as base64; '' and null give 'anonymous' (X07)."""
    digest = F.base64(F.unhex(F.substring(F.sha2(F.concat(_text(id), F.lit(salt)), 256), 1, 16)))
    return F.when(_text(id) == "", F.lit("anonymous")).otherwise(digest)


def payload_field(payload: Column, field: str) -> Column:
    """A string field of a JSON object; a payload that is a bare JSON string is its own query, title and statement."""
    value = F.get_json_object(payload, f"$.{field}")
    if field not in ("query", "title", "statement"):
        return value
    return F.coalesce(value, F.when(F.trim(payload).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), payload, F.lit("}")), "$.v")))


def estimate_tokens(operation: Column, payload: Column) -> Column:
    """Tokens by operation, plus a quarter of the bytes of what a proposal or query says."""
    op = _text(operation)

    def filled(field: str) -> Column:
        return F.nullif(payload_field(payload, field), F.lit(""))

    said = F.coalesce(filled("title"), filled("statement"), filled("decision"), F.lit(""))
    asked = F.coalesce(filled("query"), F.lit(""))
    out = F.when(op.isin("propose_decision", "mcp_propose_decision"), 100 + F.floor(F.octet_length(said) / 4)).when(op.isin("query", "mcp_query"), 50 + F.floor(F.octet_length(asked) / 4))
    for name, n in FLAT_ESTIMATES.items():
        out = out.when(op == name, F.lit(n))
    return out.otherwise(F.lit(100)).cast("long")


def estimate_tokens_conservative(operation: Column, payload_json: Column, tool: str = TOOL) -> Column:
    """200, a surcharge by the whole operation name, and a quarter of the payload's bytes, rounded up; a null payload adds nothing (X09). ``tool`` is the name in the tool server's operations."""
    op = _text(operation)
    extra = F.lit(0)
    for name, n in SURCHARGES.items():
        extra = F.when(op == name.format(tool=tool), F.lit(n)).otherwise(extra)
    return (200 + extra + F.ceil(F.octet_length(_text(payload_json)) / 4)).cast("long")


def json_text(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def extract_matches(text: Column, keywords: list[str]) -> Column:
    """What follows a keyword up to the end of its sentence, for every keyword in the text; keywords are patterns."""
    pattern = rf"(?i)({'|'.join(keywords)})\s*([^.!?]+[.!?])"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.trim(x))


def confidence(matches: Column) -> Column:
    """0 without a match, else 0.7 and 0.05 for each, 0.95 at most."""
    n = F.size(matches)
    return F.when(n > 0, F.least(F.lit(0.95), F.lit(0.7) + n * F.lit(0.05))).otherwise(F.lit(0.0))


def archive_url(channel: Column, ts: Column, base: str = "https://chat.example.com/archives") -> Column:
    """A message's link; the first '.' of its timestamp goes."""
    return F.concat(F.lit(base + "/"), channel, F.lit("/p"), F.regexp_replace(ts, r"^([^.]*)\.", "$1"))


def parse_status(c: Column) -> Column:
    known = F.lower(F.trim(c))
    return F.when(known.isin(*STATUSES), known).otherwise(F.lit("draft"))


def parse_rfc3339(c: Column) -> Column:
    return F.try_to_timestamp(c)


def epoch_unix(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def us_to_ms(c: Column) -> Column:
    return c / F.lit(1000.0)


def clamp_limit(n: int | None, low: int, high: int, default: int) -> int:
    """``n`` if it lies in [low, high], else the default."""
    return n if n is not None and low <= n <= high else default
