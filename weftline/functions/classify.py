"""Status and message classifiers, back-off and durations as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import bound


def fetch_error_code(status: Column, error: Column, rate_limited: Column) -> Column:
    """Error code of a failed fetch: by status first, then by words in the message."""
    said = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == 404, "URL_NOT_FOUND").when(status == 403, "ACCESS_DENIED").when((status == 429) | rate_limited, "RATE_LIMITED").when(status >= 500, "FETCH_ERROR")
        .when(said.contains("private") & said.contains("internal"), "SSRF_BLOCKED").when(said.contains("timeout") | said.contains("timed out"), "TIMEOUT_ERROR")
        .when(said.contains("connect") | said.contains("resolve") | said.contains("dns"), "CONNECTION_ERROR").otherwise("FETCH_ERROR")
    )


def extraction_error_code(message: Column) -> Column:
    said = F.lower(message)
    return (
        F.when(said.contains("did not match") & said.contains("selector"), "SELECTOR_NOT_FOUND").when(said.contains("invalid selector"), "INVALID_SELECTOR")
        .when(said.contains("encoding") | said.contains("decode"), "ENCODING_ERROR").otherwise("EXTRACTION_ERROR")
    )


def http_error_type(status: Column) -> Column:
    """Null for success."""
    return (
        F.when(status.between(200, 399), F.lit(None).cast("string")).when(status == 401, "auth_unauthorized").when(status == 403, "auth_forbidden").when(status == 404, "not_found")
        .when(status == 429, "rate_limited").when(status.between(400, 499), "client_error").when(status.between(500, 599), "server_error").otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def exception_type(name: Column) -> Column:
    """Canonical type of a network exception given by its class name; other names as they are."""
    # Class names of the exceptions of the HTTP client.
    timeouts = ("TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout")
    protocol = ("RemoteProtocolError", "LocalProtocolError")
    other = ("HTTPError", "RequestError", "TransportError", "NetworkError", "ReadError", "WriteError", "CloseError", "ProxyError", "HTTPStatusError", "DecodingError", "TooManyRedirects", "UnsupportedProtocol", "ProtocolError")
    return F.when(name.isin(*timeouts), "network_timeout").when(name == "ConnectError", "network_connect").when(name.isin(*protocol), "network_protocol").when(name.isin(*other), "network_error").otherwise(name)


def error_code_of_class(name: Column) -> Column:
    """Exception class name as an upper-case code without its Error ending."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, r"Error$", ""), r"(?<!^)([A-Z])", "_$1"))


def retryable(status: Column, fetcher: bool = True) -> Column:
    """Statuses that are tried again; callers don't retry on 500, the fetcher does."""
    return status.isin(*([429, 500, 502, 503, 504] if fetcher else [429, 502, 503, 504]))


def backoff_seconds(attempt: Column, retry_after: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """A numeric Retry-After, else base * 2^attempt; neither beyond ``cap``."""
    return F.least(F.coalesce(retry_after.try_cast("double"), base * F.pow(F.lit(2.0), attempt)), F.lit(cap))


def fetch_delay_seconds(attempt: Column, retry_after: Column, u: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """The fetcher's delay: a whole-number Retry-After, else base * 2^attempt with a share ``u`` (0 to 1) of the base
    added, so that callers don't come back together; neither beyond ``most``."""
    said = F.when(F.trim(retry_after).rlike(r"^[+-]?[0-9]+$"), F.trim(retry_after).try_cast("double"))
    return F.least(F.coalesce(said, base * F.pow(F.lit(2.0), attempt) + u * base), F.lit(most))


def tool_error_type(payload: Column) -> Column:
    """Error type of a tool's answer in JSON, by words in its error_code or, without one, its error."""
    text = F.lower(F.coalesce(F.nullif(F.get_json_object(payload, "$.error_code"), F.lit("")), F.get_json_object(payload, "$.error"), F.lit("")))
    has = lambda said, *words: F.greatest(*[said.contains(w) for w in words]) if len(words) > 1 else said.contains(words[0])
    return bound(
        text,
        lambda said: F.when(has(said, "auth", "token", "unauthorized"), "auth_error").when(has(said, "rate", "429", "throttl"), "rate_limited")
        .when(has(said, "timeout"), "network_timeout").when(has(said, "fetch", "network", "connect"), "network_error").otherwise("mcp_tool_failed"),
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of texts like 500ms, 10s, 5m, 1h; null for others."""
    form = r"^\s*(\d+(?:\.\d+)?)(ms|s|m|h)\s*$"
    unit = F.regexp_extract(text, form, 2)
    factor = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0)
    return F.when(unit == "ms", F.regexp_extract(text, form, 1).try_cast("double") / 1000.0).otherwise(F.regexp_extract(text, form, 1).try_cast("double") * factor)


# What to do about an error code.
RECOVERY = {
    "INVALID_URL": "Ensure the URL is properly formatted with http:// or https:// scheme.",
    "URL_NOT_FOUND": "Verify the URL exists and is accessible. The server returned 404.",
    "FETCH_ERROR": "Check network connectivity and that the target site is online. Try again later.",
    "TIMEOUT_ERROR": "The request timed out. Try increasing timeout or check if the site is slow/unresponsive.",
    "CONNECTION_ERROR": "Could not connect to the server. Verify the URL and check network connectivity.",
    "ROBOTS_BLOCKED": "Access blocked by robots.txt. Choose a URL/path that is allowed by the target site's robots policy.",
    "ACCESS_DENIED": "The server denied access. Try using a different anti-detection profile or custom headers.",
    "RATE_LIMITED": "Too many requests. Increase rate_limit_delay in set_antidetection settings.",
    "RATE_LIMIT_EXCEEDED": "Inbound rate limit exceeded. Wait and retry after the reset window.",
    "SSRF_BLOCKED": "The URL resolves to a private/internal IP. Requests to internal networks are blocked for security.",
    "SELECTOR_NOT_FOUND": "The CSS selector matched no elements. Verify the selector syntax and that the element exists on the page.",
    "INVALID_SELECTOR": "The CSS selector syntax is invalid. Check for typos and proper CSS selector format.",
    "EXTRACTION_ERROR": "Failed to extract content. The page may have unexpected structure or encoding.",
    "ENCODING_ERROR": "Character encoding issue. The page may use an unsupported encoding.",
    "MAX_DEPTH_EXCEEDED": "Crawl depth is limited to 3. Use depth=1, 2, or 3.",
    "MAX_PAGES_EXCEEDED": "Too many pages requested. Reduce max_pages_per_level (max 20).",
    "SESSION_NOT_FOUND": "Session ID not found. Use list_sessions to discover sessions, or create one with get_content(session=true).",
    "INVALID_CHUNK_INDEX": "Chunk index out of range. Use get_session_info to check the total number of chunks.",
    "PERMISSION_DENIED": "Your token's groups do not include the group that owns this session.",
    "INVALID_PROFILE": "Use one of: 'stealth', 'balanced', 'none', or 'custom' for anti-detection profile.",
    "INVALID_HEADERS": "Custom headers must be a dictionary with string keys and values.",
    "INVALID_RATE_LIMIT": "rate_limit_delay must be a non-negative number (seconds between requests).",
    "UNKNOWN_TOOL": "Available tools: ping, set_antidetection, get_content, get_structure, get_session_info, get_session_chunk, list_sessions, get_session_urls, get_session.",
    "INVALID_ARGUMENT": "A required argument is missing or invalid. Check the tool schema for required parameters.",
    "INVALID_MAX_RESPONSE_CHARS": "max_response_chars must be between 4000 and 4000000. Default is 400000 characters.",
    "AUTH_ERROR": "Provide a valid JWT token in the auth_token parameter.",
    "SESSION_ERROR": "Session operation failed. Use list_sessions to check available sessions.",
    "PARSE_ERROR": "The news parser failed to process the crawl results. Retry with parse_results=false to get raw output, or check source_profile_name for the target site.",
    "CONFIGURATION_ERROR": "Check server configuration. Contact administrator if issue persists.",
}
RECOVERY_DEFAULT = "Review the error message and try again. Contact support if the issue persists."


def recovery_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECOVERY.items()), "error_code string, recovery_strategy string")


def with_recovery(errors: DataFrame, table: DataFrame) -> DataFrame:
    """Errors with ``recovery_strategy``; codes that aren't in the table (a fixed, small one) get the default."""
    return errors.join(F.broadcast(table), "error_code", "left").withColumn("recovery_strategy", F.coalesce("recovery_strategy", F.lit(RECOVERY_DEFAULT)))


def with_tokens(consumers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Consumers (token) with symbolic tokens replaced by those of ``tokens`` (name, value), one row a name; others pass
    as they are."""
    names = tokens.select(F.col("name").alias("token"), F.col("value").alias("token_value"))
    return consumers.join(names, "token", "left").withColumn("token", F.coalesce("token_value", "token")).drop("token_value")
