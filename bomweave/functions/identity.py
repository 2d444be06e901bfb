"""Identifiers as column expressions: package URLs, CPEs, document references, checksums, licenses and versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_VERSION = "(no version)"
ABSENT = ("NOASSERTION", "NONE")
#: Documents without a namespace are named by their bytes.
SHA1_PREFIX = "urn:bomweave:sha1:"

#: Hex digits of each checksum algorithm; None for any number.
HEX_DIGITS = {
    "MD2": 32, "MD4": 32, "MD5": 32, "SHA1": 40, "SHA224": 56, "SHA256": 64, "SHA3256": 64, "BLAKE2B256": 64, "SHA384": 96, "SHA3384": 96, "BLAKE2B384": 96,
    "SHA512": 128, "SHA3512": 128, "BLAKE2B512": 128, "ADLER32": 8, "MD6": None, "BLAKE3": None,
}
#: Algorithms that a delivery is checked by, the strongest first.
STRENGTH = ["SHA512", "SHA384", "SHA256", "SHA3-512", "SHA3-256", "SHA1", "MD5"]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def percent_decoded(c: Column) -> Column:
    """Percent-decoded where that is possible, else as it is; a plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def document_id(namespace: Column, sha1: Column) -> Column:
    return F.coalesce(blank_to_null(F.trim(namespace)), F.concat(F.lit(SHA1_PREFIX), sha1))


def element_id(doc_id: Column, spdx_id: Column) -> Column:
    return F.concat(doc_id, F.lit("#"), spdx_id)


def split_element_id(c: Column) -> Column:
    """struct(doc_id, spdx_id), split at the first number sign."""
    at = F.locate("#", c)
    return F.when(at > 0, F.struct(F.substring(c, F.lit(1), at - 1).alias("doc_id"), F.substring(c, at + 1, F.length(c)).alias("spdx_id")))


def relationship_type(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "-", "_")


def element_ref(c: Column) -> Column:
    """struct(kind, ref, id): a special value, an element of another document, or one of this document."""
    outside = F.regexp_extract(c, r"^(DocumentRef-[^:]*)", 1)
    return (
        F.when(c.isin(*ABSENT), F.struct(F.lit("special").alias("kind"), F.lit(None).cast("string").alias("ref"), c.alias("id")))
        .when(outside != "", F.struct(F.lit("external").alias("kind"), outside.alias("ref"), blank_to_null(F.regexp_extract(c, r"^[^:]*:([\s\S]*)$", 1)).alias("id")))
        .otherwise(F.struct(F.lit("local").alias("kind"), F.lit(None).cast("string").alias("ref"), c.alias("id")))
    )


def element_ref_text(kind: Column, ref: Column, spdx_id: Column) -> Column:
    return F.when(kind == "external", F.concat(ref, F.coalesce(F.concat(F.lit(":"), spdx_id), F.lit("")))).otherwise(spdx_id)


def _bare_purl(purl: Column) -> Column:
    return F.regexp_extract(purl, r"^([^#?]*)", 1)


def purl_version(purl: Column) -> Column:
    """What follows the last @, if that is past the last slash."""
    return blank_to_null(percent_decoded(F.regexp_extract(_bare_purl(purl), r"@([^@/]*)$", 1)))


def purl_identity(purl: Column) -> Column:
    """The package URL as written, without version, qualifiers and subpath."""
    return F.regexp_replace(_bare_purl(purl), r"@[^@/]*$", "")


def package_key(name: Column, purl: Column, extra_identity: Column | None = None) -> Column:
    """What makes two packages the same one, whatever their versions."""
    base = F.when(purl.isNotNull() & (purl != ""), F.concat(F.lit("purl:"), purl_identity(purl))).otherwise(F.concat(F.lit("name:"), F.lower(name)))
    if extra_identity is None:
        return base
    pairs = F.transform(F.array_sort(F.map_entries(extra_identity)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(base, F.coalesce(F.concat(F.lit("#"), blank_to_null(F.array_join(pairs, ","))), F.lit("")))


def effective_license(concluded: Column, declared: Column) -> Column:
    known = lambda c: F.when(~c.isin(*ABSENT, ""), c)
    return F.coalesce(known(concluded), known(declared))


def natural_key(version: Column) -> Column:
    """A key under which digit runs of any length compare as numbers: 1.9.0 before 1.10.0. A run is led by how many digits it has."""
    runs = F.regexp_extract_all(F.lower(version), F.lit(r"(\d+|\D+)"), F.lit(1))
    led = lambda digits: F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), led(F.regexp_replace(r, r"^0+(?=\d)", ""))).otherwise(r)), "")


def purl_match_key(purl: Column) -> Column:
    """struct(id, version) under which advisories match, null for what isn't a package URL.

    Type and namespace in lower case, segments percent-decoded; the name as written.
    """

    def of_parts(parts: Column, version: Column) -> Column:
        n = F.size(parts)
        inner = F.transform(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: F.lower(percent_decoded(s)))
        key = F.concat_ws("/", F.lower(F.get(parts, F.lit(0))), F.array_join(inner, "/"), percent_decoded(F.get(parts, n - 1)))
        return F.when(n > 0, F.struct(key.alias("id"), version.alias("version")))

    def of_bare(bare: Column) -> Column:
        versioned = bare.rlike(r"^.+@[^@/]*$")
        version = F.when(versioned, blank_to_null(percent_decoded(F.regexp_extract(bare, r"@([^@/]*)$", 1))))
        path = F.when(versioned, F.regexp_extract(bare, r"^(.+)@[^@/]*$", 1)).otherwise(bare)
        return let(F.array_remove(F.split(path, "/"), ""), lambda parts: of_parts(parts, version))

    return F.when(purl.startswith("pkg:"), let(F.substring(_bare_purl(purl), F.lit(5), F.length(purl)), of_bare))


def cpe_match_key(cpe: Column) -> Column:
    """struct(id, version) of a CPE in either form, null where part, vendor or product isn't a plain name."""
    concrete = lambda c: F.coalesce((c != "") & (c != "-") & ~c.rlike(r"(?<!\\)[*?]"), F.lit(False))

    def of_parts(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        good = at(0).isin("a", "h", "o") & concrete(at(1)) & concrete(at(2))
        version = F.when(~at(3).isin("", "*", "-"), at(3))
        return F.when(good, F.struct(F.concat(F.lit("cpe|"), at(0), F.lit(":"), at(1), F.lit(":"), at(2)).alias("id"), version.alias("version")))

    def of_text(text: Column) -> Column:
        pieces = F.regexp_extract_all(F.substring(text, F.lit(9), F.length(text)), F.lit(r"((?:\\.|[^:\\])*)(?::|$)"), F.lit(1))
        new = F.transform(pieces, lambda p: F.regexp_replace(p, r"\\(.)", "$1"))
        old = F.transform(F.split(F.substring(text, F.lit(6), F.length(text)), ":"), percent_decoded)
        return let(F.when(text.startswith("cpe:2.3:"), new).when(text.startswith("cpe:/"), old), of_parts)

    return let(F.lower(F.trim(cpe)), of_text)


def match_key(ref: Column) -> Column:
    return F.coalesce(purl_match_key(ref), cpe_match_key(ref))


def normalized_path(path: Column) -> Column:
    """Without a leading ./ or /, and only then with forward slashes."""
    return F.translate(F.regexp_replace(path, r"^\.?/+", ""), "\\", "/")


def delivery_algorithm(c: Column) -> Column:
    """Upper case, the hyphen kept for the SHA-3 family only."""
    up = F.upper(F.trim(c))
    return F.when(up.startswith("SHA3-"), up).otherwise(F.replace(up, F.lit("-"), F.lit("")))


def profile_algorithm(c: Column) -> Column:
    return F.replace(F.upper(c), F.lit("-"), F.lit(""))


def lint_algorithm(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[-_]", "")


def checksum_problem(algorithm: Column, value: Column) -> Column:
    """Why a checksum is bad, or null."""
    kind = lint_algorithm(algorithm)
    digits = F.create_map(*(x for k, n in HEX_DIGITS.items() if n for x in (F.lit(k), F.lit(n))))
    return (
        F.when(~F.coalesce(kind.isin(*HEX_DIGITS), F.lit(False)), "unknown algorithm")
        .when(~F.coalesce(value.rlike(r"^[0-9a-fA-F]+\z"), F.lit(False)), "not hexadecimal")
        .when(F.length(value) != F.element_at(digits, kind), "wrong length")
    )


def is_absolute_uri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def is_fetchable(url: Column) -> Column:
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return scheme.isin("", "http", "https")


def is_sbom_like(url: Column) -> Column:
    return url.rlike(r"(?i)\.(spdx|json|ya?ml)([?#]|\z)")


def screaming_snake(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))
