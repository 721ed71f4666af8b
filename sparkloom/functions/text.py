"""Scalar functions on strings as column expressions: splitting, trimming, addresses, query strings, JSON, dates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ColumnOrName = Column | str
#: Values of parsed parameters that are shorter than this are dropped.
MIN_VALUE = 4
#: A part of a dotted address: 0 to 255, leading zeros allowed.
OCTET = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jsplit(c: ColumnOrName, sep: str) -> Column:
    """Parts between the literal ``sep``, without trailing empty parts (a text of separators alone has no part)."""
    pattern = re.escape(sep)
    parts = F.split(F.regexp_replace(_c(c), f"(?:{pattern})+$", ""), pattern, -1)
    return F.when(F.regexp_replace(_c(c), pattern, "") == "", F.when(_c(c) == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).otherwise(parts)


def jtrim(c: ColumnOrName) -> Column:
    """Without leading and trailing control characters and blanks, U+0000 to U+0020."""
    return F.regexp_replace(_c(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def half_up(c: ColumnOrName, scale: int = 2) -> Column:
    """Rounded half up, as a decimal."""
    return F.round(_c(c).cast("decimal(38,18)"), scale).cast(f"decimal(38,{scale})")


def strip_scheme(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), "^https?://", "")


def url_format(c: ColumnOrName) -> Column:
    """Without scheme, then without one trailing slash, then without a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(strip_scheme(c), "/$", ""), r"^www\.", "")


def url_no_params(c: ColumnOrName) -> Column:
    """What stands before the first question mark."""
    return F.substring_index(_c(c), "?", 1)


def url_host(c: ColumnOrName) -> Column:
    """What stands between the scheme and the first slash, port included; slashes alone come back as they are."""
    rest = strip_scheme(c)
    return F.when(rest.rlike("^/+$"), rest).otherwise(F.substring_index(rest, "/", 1))


def is_ip(c: ColumnOrName) -> Column:
    """Four parts of digits, each 0 to 255; leading zeros are fine, larger numbers are not."""
    return _c(c).rlike(f"^{OCTET}(\\.{OCTET}){{3}}$")


def host_domain(c: ColumnOrName, suffixes: Iterable[str]) -> Column:
    """The registered domain: labels from the right up to and with the first that is no suffix.

    A numeric port is dropped; any other colon gives the empty string; an address of digits stays.  ``suffixes`` is a
    list of known labels (a few hundred), a literal of the expression.
    """
    colons = F.split(_c(c), ":", -1)
    host = F.when(F.size(colons) == 1, _c(c)).when((F.size(colons) == 2) & F.get(colons, 1).rlike("^[0-9]+$"), F.get(colons, 0))
    labels = F.reverse(jsplit(host, "."))
    known = F.array(*[F.lit(s) for s in sorted(set(suffixes))]).cast("array<string>")
    n = F.aggregate(labels, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"], a).otherwise(F.struct((a["n"] + 1).alias("n"), (~F.array_contains(known, x)).alias("done"))))["n"]
    domain = F.array_join(F.reverse(F.slice(labels, 1, F.greatest(n, F.lit(1)))), ".")
    return F.when(_c(c).isNull(), None).when(host.isNull(), "").when(is_ip(host), host).otherwise(domain)


#: A text of UTF-16 units in hex that has no half of a pair alone.
_WHOLE = "^(?:[0-9A-Ca-cE-Fe-f][0-9A-Fa-f]{3}|[dD][0-7][0-9A-Fa-f]{2}|[dD][89ABab][0-9A-Fa-f]{2}[dD][C-Fc-f][0-9A-Fa-f]{2})*+$"


def _units(c: Column, mark: str) -> Column:
    """Text whose ``mark`` (a pattern) and four hex digits stand for UTF-16 units; null if half a pair is alone."""
    parts = F.split(c, mark + "(?=[0-9a-fA-F]{4})", -1)
    code = lambda x: F.hex(F.encode(x, "UTF-16BE"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    units = F.aggregate(rest, code(F.get(parts, 0)), lambda a, x: F.concat(a, F.substring(x, 1, 4), code(F.substr(x, F.lit(5)))))
    return F.when(units.rlike(_WHOLE), F.decode(F.unhex(units), "UTF-16BE"))


def url_decode_lenient(c: ColumnOrName) -> Column:
    """Percent-decoded text, with ``%uXXXX`` and then ``\\uXXXX`` as UTF-16 units; the empty string where the text can't
    be decoded.  All of it stays in the JVM."""
    c = _c(c)
    units = F.when(c.rlike("%(?!u[0-9a-fA-F]{4}|[0-9a-fA-F]{2})"), None).otherwise(_units(c, "%u"))
    plain = F.try_url_decode(F.when(c.contains("%u"), units).otherwise(c))
    decoded = F.when(plain.contains("\\u"), _units(plain, r"\\u")).otherwise(plain)
    return F.when(c.isNotNull(), F.coalesce(decoded, F.lit("")))


def _pairs(text: Column, sep: str, tidy: bool) -> Column:
    """Map of the ``key=value`` parts; short values go, the last of equal keys wins."""
    trim = jtrim if tidy else (lambda x: x)
    entries = F.transform(
        F.filter(F.split(text, sep, -1), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(trim(F.substring_index(p, "=", 1)).alias("key"), trim(url_decode_lenient(F.substr(p, F.instr(p, "=") + 1))).alias("value")),
    )
    entries = F.filter(entries, lambda e: (F.length(e["value"]) >= MIN_VALUE) & (e["key"] != ""))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def query_params(c: ColumnOrName) -> Column:
    """The parameters after the first question mark, decoded; an address without any has an empty map."""
    return _pairs(F.when(F.instr(_c(c), "?") > 0, F.substr(_c(c), F.instr(_c(c), "?") + 1)).otherwise(F.when(_c(c).isNotNull(), "")), "&", False)


def cookie_params(c: ColumnOrName) -> Column:
    """The parts of a cookie, keys and values trimmed."""
    return _pairs(_c(c), ";", True)


def parse_date(c: ColumnOrName) -> Column:
    """yyyy-MM-dd as a date, strictly; null for anything else."""
    return F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd")).cast("date")


def format_date(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def date_millis(c: ColumnOrName) -> Column:
    """Milliseconds since 1970 of a yyyy-MM-dd date."""
    return F.unix_millis(F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd")))


def seconds(c: ColumnOrName) -> Column:
    """Seconds since 1970 of a yyyy-MM-dd HH:mm:ss time."""
    return F.unix_seconds(F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd HH:mm:ss")))


def tail(c: ColumnOrName, sep: str = " ", out: str = ",") -> Column:
    """All parts but the first, joined anew."""
    parts = jsplit(c, sep)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), out)


def pair(line: ColumnOrName, sep: str) -> Column:
    """A struct of the two parts of a line, or null if there aren't two."""
    parts = jsplit(line, sep)
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, 0).alias("left"), F.get(parts, 1).alias("right")))


def join_pair(left: ColumnOrName, right: ColumnOrName, sep: str) -> Column:
    return F.concat_ws(sep, _c(left), _c(right))


def from_json_or_null(c: ColumnOrName, schema: StructType | str, zero: Sequence[str] = ()) -> Column:
    """A struct, null where the line is malformed or no object; drop those rows to skip them.  Fields in ``zero`` that
    an object lacks are 0, others null."""
    c = _c(c)
    read = F.when(F.ltrim(c).startswith("{") & F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    for name in zero:
        read = F.when(read.isNotNull(), read.withField(name, F.coalesce(read.getField(name), F.lit(0))))
    return read


def weight_text(name: ColumnOrName, weight: ColumnOrName) -> Column:
    """``name:0.330000``."""
    return F.format_string("%s:%2f", _c(name), _c(weight).cast("double"))


def set_bits(bits: ColumnOrName, flag: int) -> Column:
    return _c(bits).bitwiseOR(F.lit(flag))


def has_bits(bits: ColumnOrName, flag: int) -> Column:
    return _c(bits).bitwiseAND(F.lit(flag)) == flag


def merge_sums(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Two maps in one; values of keys that both have are added."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def running_mean(total: ColumnOrName, count: ColumnOrName) -> Column:
    """total / count; null without rows."""
    return F.try_divide(_c(total).cast("double"), _c(count))


def register(spark: SparkSession, suffixes: Sequence[str] = ()) -> None:
    """Makes the address functions known to SQL, as SQL expressions: url_format, url_host, url_no_params, is_ip,
    host_domain (with ``suffixes``) and url_decode_lenient.  The parameter maps take a lambda, in which SQL functions
    can't be called, so they are there as column functions only."""
    rest = "regexp_replace(c, '^https?://', '')"
    code = lambda x: f"hex(encode({x}, 'UTF-16BE'))"
    known = "array(" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(set(suffixes))) + ")"
    clean = lambda sep: f"regexp_replace(c, '({sep})+$', '')"

    def units(mark: str) -> str:
        parts = f"split(c, '{mark}(?=[0-9a-fA-F]{{4}})', -1)"
        return f"aggregate(slice({parts}, 2, greatest(size({parts}) - 1, 0)), {code(f'get({parts}, 0)')}, (a, x) -> concat(a, substring(x, 1, 4), {code('substring(x, 5)')}))"

    bodies = {
        "url_format": ("STRING", f"regexp_replace(regexp_replace({rest}, '/$', ''), '^www[.]', '')"),
        "url_no_params": ("STRING", "substring_index(c, '?', 1)"),
        "url_host": ("STRING", f"CASE WHEN {rest} RLIKE '^/+$' THEN {rest} ELSE substring_index({rest}, '/', 1) END"),
        "is_ip": ("BOOLEAN", f"c RLIKE '^{OCTET}([.]{OCTET}){{3}}$'"),
        "sparkloom_percent_units": ("STRING", f"CASE WHEN {units('%u')} RLIKE '{_WHOLE}' THEN decode(unhex({units('%u')}), 'UTF-16BE') END"),
        "sparkloom_escaped_units": ("STRING", f"CASE WHEN {units('[\\\\\\\\]u')} RLIKE '{_WHOLE}' THEN decode(unhex({units('[\\\\\\\\]u')}), 'UTF-16BE') END"),
        "sparkloom_percent": ("STRING", "try_url_decode(CASE WHEN c RLIKE '%(?!u[0-9a-fA-F]{4}|[0-9a-fA-F]{2})' THEN NULL WHEN contains(c, '%u') THEN sparkloom_percent_units(c) ELSE c END)"),
        "url_decode_lenient": ("STRING", "CASE WHEN c IS NOT NULL THEN coalesce(CASE WHEN contains(sparkloom_percent(c), '\\\\u') THEN sparkloom_escaped_units(sparkloom_percent(c)) ELSE sparkloom_percent(c) END, '') END"),
        "sparkloom_domain": ("STRING", f"array_join(reverse(slice(reverse(split({clean('[.]')}, '[.]', -1)), 1, greatest(aggregate(reverse(split({clean('[.]')}, '[.]', -1)), struct(0 AS n, false AS done), (a, x) -> CASE WHEN a.done THEN a ELSE struct(a.n + 1 AS n, NOT array_contains(CAST({known} AS ARRAY<STRING>), x) AS done) END).n, 1))), '.')"),
        "host_domain": ("STRING", "CASE WHEN c IS NULL THEN NULL WHEN c NOT LIKE '%:%' THEN CASE WHEN is_ip(c) THEN c ELSE sparkloom_domain(c) END WHEN c RLIKE '^[^:]*:[0-9]+$' THEN CASE WHEN is_ip(substring_index(c, ':', 1)) THEN substring_index(c, ':', 1) ELSE sparkloom_domain(substring_index(c, ':', 1)) END ELSE '' END"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c STRING) RETURNS {kind} RETURN {body}")
