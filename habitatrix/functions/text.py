"""Column expressions on identifiers, dates, keys and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns and labels of the data contract.
_TRAILING_DIGITS = r"([0-9]+)\z"
_LSID_DIGITS = r":Taxon:([0-9]+)(?=\n?\z)"
_DATE_TOKEN = r"([0-9]{4}(?:-[0-9]{2}){0,2})"
_FILE_NAME_JUNK = r"[^A-Za-z0-9_\-\.åäöÅÄÖ]"


def _group_or_null(c: Column, pattern: str) -> Column:
    # regexp_extract gives '' for "no match"; inside the engine that is NULL
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def taxon_number(c: Column) -> Column:
    """Digits at the very end of any identifier, as BIGINT (lenient form)."""
    return _group_or_null(c.cast("string"), _TRAILING_DIGITS).try_cast("bigint")


def lsid_taxon(c: Column) -> Column:
    """Digits of a ``...:Taxon:<n>`` identifier, as text (strict form)."""
    return _group_or_null(c.cast("string"), _LSID_DIGITS)


def day_text(c: Column) -> Column:
    """First year / month / day token in free text, padded to ``YYYY-MM-DD``.

    The result stays text: out-of-range months such as ``2020-13-01`` are legal.
    """
    tok = _group_or_null(c.cast("string"), _DATE_TOKEN)
    return (
        F.when(F.length(tok) == 4, F.concat(tok, F.lit("-01-01")))
        .when(F.length(tok) == 7, F.concat(tok, F.lit("-01")))
        .otherwise(tok)
    )


def grid_round(c: Column, decimals: int) -> Column:
    """Round on the scaled value, half away from zero."""
    scale = float(10**decimals)
    return F.round(c.cast("double") * F.lit(scale)) / F.lit(scale)


def cell_key(lat_r: Column, lon_r: Column) -> Column:
    """``cell_<lat>_<lon>`` without zero padding, NULL when a part is missing."""
    return F.concat(
        F.lit("cell_"), lat_r.cast("string"), F.lit("_"), lon_r.cast("string")
    )


def with_milli(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add thousandths of a double as BIGINT, rounded on the exact binary value.

    ``format_string('%.3f')`` rounds the shortest decimal text and so moves ties
    the wrong way about half of the time.  Here ``value * 1000`` is split into a
    rounded product and its exact error, which decides every tie (to even)
    without leaving the JVM.
    """
    kept = df.columns
    for source, out in columns.items():
        c = F.col(source).cast("double")
        a, hi, p = F.col("_a"), F.col("_hi"), F.col("_p")
        k, over = F.col("_k"), F.col("_over")
        split = a * F.lit(134217729.0)
        err = (hi * F.lit(1000.0) - p) + (a - hi) * F.lit(1000.0)
        up = F.when(over > 0, 1).when((over == 0) & (k % 2 == 1), 1).otherwise(0)
        df = (
            df.withColumn("_a", F.abs(c))
            .withColumns({"_hi": split - (split - a), "_p": a * F.lit(1000.0)})
            .withColumns({"_k": F.floor(p), "_over": (p - F.floor(p) - F.lit(0.5)) + err})
            .withColumn(out, F.when(c < 0, -(k + up)).otherwise(k + up))
            .select(*kept, out)
        )
        kept = [*kept, out]
    return df


def milli_text(m: Column) -> Column:
    """``<whole>.<three digits>`` of thousandths."""
    size = F.abs(m)
    whole = F.floor(size / F.lit(1000)).cast("bigint").cast("string")
    sign = F.when(m < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), F.lpad((size % 1000).cast("string"), 3, "0"))


def padded_cell_key(lat_milli: Column, lon_milli: Column) -> Column:
    """``cell_<lat>_<lon>`` with three fixed decimals, from thousandths."""
    return F.concat(F.lit("cell_"), milli_text(lat_milli), F.lit("_"), milli_text(lon_milli))


def canonical_cell(key: Column) -> Column:
    """One spelling for cell keys: ``cell_61.7_16.16`` becomes the padded form.

    Other keys stay as they are.
    """
    number = r"(-?[0-9]+)(?:\.([0-9]{1,3}))?"
    pattern = f"^cell_{number}_{number}$"
    part = [F.regexp_extract(key, pattern, i) for i in range(1, 5)]
    lat = F.concat(part[0], F.lit("."), F.rpad(part[1], 3, "0"))
    lon = F.concat(part[2], F.lit("."), F.rpad(part[3], 3, "0"))
    return F.when(key.rlike(pattern), F.concat(F.lit("cell_"), lat, F.lit("_"), lon)).otherwise(key)


def named_locality(locality_id: Column | None, locality: Column | None) -> Column:
    """First non-empty of locality id and locality text."""
    named = [
        F.nullif(c.cast("string"), F.lit(""))
        for c in (locality_id, locality)
        if c is not None
    ]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def locality_key(
    locality_id: Column | None, locality: Column | None, lat_milli: Column, lon_milli: Column
) -> Column:
    """Named locality if there is one, else the padded coordinate cell."""
    return F.coalesce(
        named_locality(locality_id, locality), padded_cell_key(lat_milli, lon_milli)
    )


def habitat_slug(c: Column) -> Column:
    """Lower-case ``a-z`` words joined by ``_``; ``unknown`` if none is left."""
    slug = F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def name_norm(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def genus_species(c: Column) -> Column:
    """First two words of the normalised name."""
    return F.substring_index(name_norm(c), " ", 2)


def safe_name(c: Column) -> Column:
    """Name usable as a folder name; Swedish letters survive."""
    return F.regexp_replace(
        F.replace(composed(F.trim(c)), F.lit(" "), F.lit("_")), _FILE_NAME_JUNK, "_"
    )


def composed(c: Column) -> Column:
    """Letters and their marks joined (NFC), by the Unicode library that Spark brings along.

    Texts of plain ASCII, nearly all of them, are not touched.
    """
    joined = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)
    )
    return F.when(c.rlike(r"[^\x00-\x7F]"), joined).otherwise(c)


def name_seed(c: Column, base: int) -> Column:
    """Seed from the first eight hex digits of the name's MD5, plus ``base``."""
    head = F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10)
    return head.cast("bigint") + F.lit(base)


def subsample_size(m: Column, smallest: int, largest: int, fraction: float) -> Column:
    """How many of ``m`` localities one sub-sample draws."""
    share = F.floor(m.cast("double") * F.lit(fraction))
    grown = F.least(F.greatest(share, F.lit(smallest)), F.lit(largest), m)
    return (
        F.when(m <= 0, F.lit(0)).when(m < smallest, m).otherwise(grown).cast("bigint")
    )


def length_then_text(ids: Column) -> Column:
    """Array of id texts ordered by length, then text (numeric order)."""
    keyed = F.transform(ids, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def half_even_int(c: Column) -> Column:
    """Whole number, ties to even; 0 when there is no value."""
    return F.coalesce(F.rint(c).cast("bigint"), F.lit(0).cast("bigint"))
