"""Scalar column functions: labels, durations, limits, arguments and map listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_index(partition_id: Column) -> Column:
    """Partitions are numbered from 0 in the data and from 1 for people."""
    return partition_id + 1


def role_letter(is_primary: Column) -> Column:
    """``P`` for a primary, ``B`` for everything else."""
    return F.when(F.coalesce(is_primary, F.lit(False)), "P").otherwise("B")


def instance_label(
    pu: Column, partition_id: Column, stateful: Column, is_primary: Column, partition_has_primary: Column
) -> Column:
    detail = F.concat(F.lit(" (#"), partition_index(partition_id).cast("string"), role_letter(is_primary), F.lit(")"))
    shown = F.coalesce(stateful & partition_has_primary, F.lit(False))
    return F.concat(pu, F.when(shown, detail).otherwise(""))


def pad_left(value: Column, width: int) -> Column:
    """Pad with spaces; longer text is kept whole."""
    return F.format_string(f"%{width}s", value.cast("string"))


def pad_right(value: Column, width: int) -> Column:
    return F.format_string(f"%-{width}s", value.cast("string"))


def jvm_description(vendor: Column, name: Column, version: Column) -> Column:
    return F.concat_ws(" : ", vendor, name, version)


def round_half_up(value: Column) -> Column:
    """Halves go towards positive infinity, so -2.5 gives -2."""
    return F.floor(value + F.lit(0.5))


def uptime(as_of: Column, start: Column) -> Column:
    return as_of - start


# ISO-8601 duration: sign, days, then hours, minutes and seconds after a T
_DURATION = (
    r"(?i)^([-+]?)P(?:([-+]?\d+)D)?(T(?:([-+]?\d+)H)?(?:([-+]?\d+)M)?(?:([-+]?\d+)(?:[.,](\d{0,9}))?S)?)?$"
)


def duration_micros(text: Column) -> Column:
    """Microseconds of an ISO-8601 duration; null stays null, any other text that is not one is an error."""
    # one pass of the pattern: sign, days, hours, minutes, seconds, fraction, time part
    pieces = F.regexp_replace(text, _DURATION, "$1\x01$2\x01$4\x01$5\x01$6\x01$7\x01$3")
    failure = F.raise_error(F.concat(F.lit("not an ISO-8601 duration: "), text)).cast("bigint")

    def value(p: Column) -> Column:
        def number(index: int) -> Column:
            return F.when(p[index] == "", F.lit("0")).otherwise(p[index]).cast("bigint")

        fraction = F.rpad(p[5], 6, "0").cast("bigint")
        seconds = number(1) * 86400 + number(2) * 3600 + number(3) * 60 + number(4)
        micros = seconds * 1_000_000 + F.when(F.startswith(p[4], F.lit("-")), -fraction).otherwise(fraction)
        # "P" alone and a T with nothing after it are not durations
        given = F.concat(p[1], p[2], p[3], p[4]) != ""
        valid = (F.size(p) == 7) & given & (F.lower(p[6]) != "t")
        return F.when(valid, F.when(p[0] == "-", -micros).otherwise(micros)).otherwise(failure)

    # a text the pattern does not match comes back unchanged
    matched = F.when(pieces != text, F.split(pieces, "\x01")).otherwise(F.array(text))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(matched), value), F.lit(0)))


def parse_duration(text: Column) -> Column:
    """ISO-8601 text as a day-time interval."""
    micros = duration_micros(text)
    return F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(38,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    )


def parse_zone_limits(text: Column) -> Column:
    """``A/1, B/2`` to a map; items without a count are skipped, a repeated zone keeps its last count."""

    def parts(item: Column) -> Column:
        # empty parts at the end do not count: "A/" has one part, "/" none
        trimmed = F.regexp_replace(item, "/+$", "")
        return F.when((trimmed == "") & (item != ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, "/"))

    def entry(item: Column) -> Column:
        return F.struct(
            F.trim(F.get(parts(item), F.lit(0))).alias("key"),
            F.trim(F.get(parts(item), F.lit(1))).try_cast("int").alias("value"),
        )

    items = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ",+$", ""), ",")
    bad = F.exists(items, lambda i: ~F.size(parts(i)).isin(1, 2))
    entries = F.transform(F.filter(items, lambda i: F.size(parts(i)) == 2), entry)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]),
    )
    # a count that is no number is an error whatever the session's cast mode
    unread = F.exists(entries, lambda e: e["value"].isNull())
    failure = F.raise_error(F.concat(F.lit("invalid zone limits: "), text)).cast("map<string,int>")
    return F.when(bad | unread, failure).otherwise(F.map_from_entries(last))


def format_zone_limits(limits: Column, count_first: bool = False) -> Column:
    """Map to text; null for a null or empty map. ``count_first`` writes ``1/A`` instead of ``A/1``."""

    def item(e: Column) -> Column:
        pieces = (e["value"].cast("string"), e["key"]) if count_first else (e["key"], e["value"].cast("string"))
        return F.concat(pieces[0], F.lit("/"), pieces[1])

    text = F.array_join(F.transform(F.array_sort(F.map_entries(limits)), item), ",")
    return F.when(F.size(limits) > 0, text)


def filter_jvm_args(text: Column, drop: str) -> Column:
    """Arguments split on spaces and rejoined, without blanks and without the placeholder token ``drop``."""
    words = F.transform(F.split(text, " "), lambda w: F.regexp_replace(w, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(words, lambda w: (w != "") & (w != F.lit(drop))), " ")


def without_passwords(options: Column) -> Column:
    return F.filter(options, lambda o: ~F.contains(o, F.lit("password")))


def text_of(value: Column) -> Column:
    """Any value as text; null becomes the word ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def masked(value: Column, is_secret: Column) -> Column:
    return F.when(F.coalesce(is_secret, F.lit(False)), F.lit("****")).otherwise(value)


def sorted_entries(values: Column) -> Column:
    return F.array_sort(F.map_entries(values))


def map_listing(values: Column) -> Column:
    """``key : value`` lines in key order."""
    return F.array_join(
        F.transform(sorted_entries(values), lambda e: F.concat(e["key"], F.lit(" : "), text_of(e["value"]))), "\n"
    )
