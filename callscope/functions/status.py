"""Status, failure and error expressions: Column to Column, evaluated by Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses, failure kinds and the phrases that mark them, in the order in which they are tried.
SUCCESS = ("success", "completed", "warning_success")
IN_FLIGHT = ("running", "pending")
ABORT = "downstream_closed"
PHRASES = (
    ("downstream closed while streaming upstream response", "downstream_closed"),
    ("upstream response stream reported failure", "upstream_response_failed"),
    ("upstream stream error", "upstream_stream_error"),
    ("failed to contact upstream", "failed_contact_upstream"),
    ("[upstream_response_failed]", "upstream_response_failed"),
    ("upstream response failed", "upstream_response_failed"),
    ("upstream handshake timed out", "upstream_handshake_timeout"),
    ("request body read timed out", "request_body_read_timeout"),
    ("failed to read request body stream", "request_body_stream_error_client_closed"),
    ("invalid api key format", "invalid_api_key"),
    ("api key format is invalid", "invalid_api_key"),
    ("incorrect api key provided", "invalid_api_key"),
    ("api key not found", "api_key_not_found"),
    ("please provide an api key", "api_key_missing"),
)
CLIENT_PHRASES = ("invalid api key format", "api key format is invalid", "incorrect api key provided", "api key not found", "please provide an api key")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def norm(status: Column) -> Column:
    return F.lower(blank(status))


def success_like(status: Column, error: Column) -> Column:
    return norm(status).isin(*SUCCESS) | ((norm(status) == "http_200") & (blank(error) == ""))


def long_term_success(status: Column, error: Column) -> Column:
    return success_like(status, error) | norm(status).isin("succeeded", "ok")


def in_flight(status: Column) -> Column:
    return norm(status).isin(*IN_FLIGHT)


def terminal(status: Column) -> Column:
    return ~in_flight(status)


def live_phase(status: Column, first_byte: Column, account: Column) -> Column:
    """queued, requesting or responding, for a call in flight."""
    return F.when(norm(status) == "pending", "queued").when(first_byte.isNotNull(), "responding").when(account.isNotNull(), "requesting").otherwise("queued")


def kind_prefix(error: Column) -> Column:
    """The text of a leading [...] of the error; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(error), r"^\[([^\]]+)\]", 1)), F.lit(""))


def _derived(s: Column, low: Column) -> Column:
    chain = reduce(lambda c, p: c.when(F.contains(low, F.lit(p[0])), p[1]), PHRASES[1:], F.when(F.contains(low, F.lit(PHRASES[0][0])), PHRASES[0][1]))
    return chain.when((s == "http_200") & (low == ""), None).when(s.startswith("http_"), s).when(low != "", "untyped_failure")


def derived_kind(status: Column, error: Column) -> Column:
    return _derived(norm(status), F.lower(blank(error)))


def _quiet(s: Column, low: Column, given: Column) -> Column:
    return (low == "") & ((s.isin(*SUCCESS) & given.isNull()) | s.isin(*IN_FLIGHT) | ((s == "") & given.isNull()))


def _label(s: Column, low: Column, given: Column, k: Column) -> Column:
    limited = (s == "http_429") | (k == "upstream_http_429")
    client = reduce(lambda a, p: a | F.contains(low, F.lit(p)), CLIENT_PHRASES, (k == "request_body_stream_error_client_closed") | s.startswith("http_4"))
    fine = (low == "") & (((k == "") & s.isin("success", "completed", "http_200")) | ((s == "warning_success") & k.isin("", ABORT)))
    return (
        F.when(_quiet(s, low, given) | ((s == "warning_success") & (k == ABORT) & (low == "")), "none")
        .when((k == ABORT) | F.contains(low, F.lit(PHRASES[0][0])), "client_abort")
        .when(limited, "service_failure").when(client, "client_failure").when(fine, "none").otherwise("service_failure")
    )


def _struct(s: Column, low: Column, given: Column, found: Column, label: Column) -> Column:
    return F.struct(F.when(~_quiet(s, low, given) & ((label != "none") | (s == "warning_success")), found).alias("kind"), label.alias("class"), (label == "service_failure").alias("actionable"))


def failure(status: Column, error: Column, kind: Column | None = None) -> Column:
    """struct(kind, class, actionable): class is none, service_failure, client_failure or client_abort; only service failures are actionable."""
    given = F.nullif(blank(kind), F.lit("")) if kind is not None else F.lit(None).cast("string")
    s, low = norm(status), F.lower(blank(error))
    found = F.coalesce(given, kind_prefix(error), _derived(s, low))
    return _struct(s, low, given, found, _label(s, low, given, F.lower(F.coalesce(found, F.lit("")))))


def with_failure(rows: DataFrame, status: str = "status", error: str = "error_message") -> DataFrame:
    """rows with ok (success-like), flying, kind, class and actionable. In steps, so that each part is evaluated once."""
    s, low, none = F.col("__s"), F.col("__low"), F.lit(None).cast("string")
    out = rows.withColumns({"__s": norm(F.col(status)), "__low": F.lower(blank(F.col(error)))})
    out = out.withColumn("__kind", F.coalesce(kind_prefix(F.col(error)), _derived(s, low)))
    out = out.withColumn("class", _label(s, low, none, F.lower(F.coalesce("__kind", F.lit("")))))
    quiet = _quiet(s, low, none)
    return out.withColumns({
        "ok": s.isin(*SUCCESS) | ((s == "http_200") & (low == "")), "flying": s.isin(*IN_FLIGHT), "actionable": F.col("class") == "service_failure",
        "kind": F.when(~quiet & ((F.col("class") != "none") | (s == "warning_success")), F.col("__kind")),
    }).drop("__s", "__low", "__kind")


def resolved(stored_class: Column, stored_kind: Column, derived: Column) -> Column:
    """struct(kind, class, actionable) of stored and derived values: a stored none loses to a derived failure, a stored kind wins."""
    label = F.when(stored_class.isNull() | (stored_class == "none"), derived["class"]).otherwise(stored_class)
    return F.struct(F.coalesce(F.nullif(F.trim(stored_kind), F.lit("")), derived["kind"]).alias("kind"), label.alias("class"), (label == "service_failure").alias("actionable"))


def scope(label: Column, name: str = "service") -> Column:
    """Whether a class falls in the scope all, service, client or abort."""
    names = {"all": ("service_failure", "client_failure", "client_abort"), "service": ("service_failure",), "client": ("client_failure",), "abort": ("client_abort",)}
    if name not in names:
        raise ValueError(f"unknown failure scope {name!r}")
    return label.isin(*names[name])


def http_code(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"(?i)\bhttp\s*:?\s*(\d{3})\b", 1), F.lit("")).cast("int")


def normalised(error: Column) -> Column:
    """The error text without times, ids, URL queries and large numbers, at most 160 characters; null if nothing is left."""
    low = F.lower(F.trim(error))
    code = F.nullif(F.regexp_extract(low, r"\bhttp\s*(\d{3})\b", 1), F.lit(""))
    out = low
    for pattern, by in (
        (r"\b\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}:\d{2}(?:\.\d+)?z?\b", ""), (r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", ""), (r"\b[a-z0-9_\-]{10,}\b", ""),
        (r"(https?://[^\s'\"?#]+)[^\s'\"]*", "$1"), (r"\b\d{4,}\b", ""), ("request failed:", "request failed"), ("exception recovered:", "exception"), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    prefixed = lambda x: F.when(x["code"].isNotNull() & ~F.contains(x["text"], x["code"]), F.concat(F.lit("http "), x["code"], F.lit(": "), x["text"])).otherwise(x["text"])
    # One evaluation of the chain, though its result is used three times.
    out = F.get(F.transform(F.array(F.struct(F.trim(out).alias("text"), code.alias("code"))), prefixed), F.lit(0))
    typed = F.when(F.trim(error).startswith("{"), F.get_json_object(F.trim(error), "$.error.type"))
    return F.nullif(F.when(typed.isNotNull(), F.concat(F.lit("json error: "), typed)).otherwise(F.substring(out, 1, 160)), F.lit(""))


def category(error: Column) -> Column:
    code, typed = http_code(error), F.when(F.ltrim(error).startswith("{"), F.get_json_object(error, "$.error.type"))
    label = lambda: F.concat(F.lit("HTTP "), code.cast("string"))
    client = (
        F.when(typed.isNotNull(), typed).when(error.rlike(r"(?i)usage[_\s-]*not[_\s-]*included"), "usage_not_included").when(error.rlike(r"(?i)usage[_\s-]*limit[_\s-]*reached"), "usage_limit_reached")
        .when((code == 429) & error.rlike(r"(?i)too\s+many\s+requests"), "too_many_requests").when(code == 429, "http_429").when(code == 401, "unauthorized").when(code == 403, "forbidden").when(code == 404, "not_found").otherwise(label())
    )
    return F.when(blank(error) == "", "Other").when(code >= 501, label()).when(code.between(400, 499), client).otherwise(F.coalesce(normalised(error), F.lit("Other")))


def outcome(status: Column, error: Column) -> Column:
    """success, failure, in_flight or neutral."""
    label = failure(status, error)["class"]
    return F.when(in_flight(status), "in_flight").when(label != "none", "failure").when(success_like(status, error), "success").otherwise("neutral")


def non_success(status: Column, error: Column) -> Column:
    return (norm(status) == "interrupted") | (terminal(status) & (failure(status, error)["class"] != "none"))
