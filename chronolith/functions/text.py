"""Formatting, argument parsing and exclusion rules."""

import re

from pyspark.sql import functions as F


def hash_hex(h):
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def asset_path(h):
    """Relative path of an asset's own file: folders by the first two pairs of hex digits."""
    name = hash_hex(h)
    return F.concat_ws("/", F.substring(name, 1, 2), F.substring(name, 3, 2), F.concat(name, F.lit(".tile")))


def segment_name(n):
    """File name of a day's n-th log segment; the first has no number."""
    return F.when(n == 0, F.lit("log.bin")).otherwise(F.format_string("log.%04d.bin", n))


def snapshot_name(t):
    return F.concat(t.cast("string"), F.lit(".ckpt"))


def snapshot_time(name):
    """The time in a snapshot's file name, null where there is none."""
    return F.nullif(F.regexp_extract(name, r"([+-]?[0-9]+)\.[^./]*$", 1), F.lit("")).try_cast("long")


def clock(us):
    """hh:mm:ss of a duration in µs; hours grow."""
    s = F.floor(us / 1_000_000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def bytes_text(n):
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.2f GB", n / (1 << 30)))


def percent(part, whole):
    return F.when(whole == 0, F.lit(100.0)).otherwise(100.0 * part / whole)


def backoff_ms(failures):
    return F.least(F.lit(60_000), 5000 * F.pow(F.lit(2), F.least(F.lit(4), failures - 1))).cast("long")


def process_pattern(rule: str) -> str:
    """A process rule as a pattern: .exe dropped, * for anything, anchored, any case."""
    name = re.sub(r"\.exe$", "", rule, flags=re.I)
    return "(?i)^" + ".*".join(re.escape(p) for p in name.split("*")) + "$"


def title_pattern(rule: str) -> str:
    """A title rule: /pattern/ or a part of the title, any case; a bad pattern is taken literally."""
    if len(rule) > 2 and rule[0] == rule[-1] == "/":
        try:
            re.compile(rule[1:-1])
            return "(?i)" + rule[1:-1]
        except re.error:
            pass
    return "(?i)" + re.escape(rule)


def excluded(process, title, processes: list[str], titles: list[str]):
    """True where a rule names the process or the title; nulls count as empty."""
    name = F.regexp_replace(F.coalesce(process, F.lit("")), r"(?i)\.exe$", "")
    tests = [name.rlike(process_pattern(r)) for r in processes] + [F.coalesce(title, F.lit("")).rlike(title_pattern(r)) for r in titles]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def instant(text, day_start_us):
    """µs of a time argument: +seconds after the day's start, epoch milliseconds (12 digits or more), or HH:mm:ss."""
    h, m, s = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d{1,3})?)$", i) for i in (1, 2, 3))
    of_day = (h.cast("double") * 3600 + m.cast("double") * 60 + s.cast("double")) * 1_000_000
    return (
        F.when(text.rlike(r"^\+\d+(\.\d+)?$"), day_start_us + (F.substring(text, 2, 32).cast("double") * 1_000_000).cast("long"))
        .when(text.rlike(r"^\d{12,}$"), text.cast("long") * 1000)
        .when(text.rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d{1,3})?$"), day_start_us + of_day.cast("long"))
    )


DASH = "—"  # shown for what isn't known


def _known(value, known, shown):
    return F.when(value.isNotNull() & known, shown).otherwise(DASH)


def size(n):
    """Bytes with a decimal for small figures, as a display shows them."""
    steps = F.when(n < 1024, F.format_string("%.0f B", n.cast("double")))
    for unit, at, few, many in (("KB", 10, 1, 0), ("MB", 20, 1, 0), ("GB", 30, 2, 1)):
        v = n / float(1 << at)
        shown = F.when(v < 10, F.format_string(f"%.{few}f {unit}", v)).otherwise(F.format_string(f"%.{many}f {unit}", v))
        steps = steps.when(v < 1024, shown) if unit != "GB" else steps.otherwise(shown)
    return _known(n, F.lit(True), steps)


def duration(us):
    """A duration in µs in its two largest units."""
    s, n = us / 1_000_000.0, F.floor(us / 1_000_000)
    shown = (
        F.when(us < 1_000_000, F.format_string("%.0fms", us / 1000.0)).when(s < 10, F.format_string("%.1fs", s)).when(s < 60, F.format_string("%.0fs", s))
        .when(n >= 3600, F.format_string("%dh %02dm", F.floor(n / 3600), F.floor(n % 3600 / 60))).otherwise(F.format_string("%dm %02ds", F.floor(n / 60), n % 60))
    )
    return _known(us, us >= 0, shown)


def duration_clock(us):
    """A duration in µs as m:ss, or h:mm:ss from an hour on."""
    n = F.floor(us / 1_000_000)
    shown = F.when(n >= 3600, F.format_string("%d:%02d:%02d", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60)).otherwise(F.format_string("%d:%02d", F.floor(n / 60), n % 60))
    return _known(us, us >= 0, shown)


def wall_clock(us, pattern: str = "HH:mm:ss"):
    """Time of day of an instant in the session's time zone; HH:mm:ss.SSS and HH:mm are the other two forms."""
    return _known(us, F.lit(True), F.date_format(F.timestamp_micros(us), pattern))


def day_long(day):
    """Weekday, day, month and year of yyyy-MM-dd; other texts as they are."""
    parsed = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "EEE d MMM yyyy"))
    return F.coalesce(parsed, F.when(day != "", day), F.lit(DASH))


def count(n):
    return _known(n, F.lit(True), F.format_number(n.cast("double"), 0))


def number(x, digits: int = 1, unit: str = ""):
    return _known(x, ~F.isnan(x.cast("double")), F.format_string(f"%.{digits}f" + unit.replace("%", "%%"), x.cast("double")))


def speed(x):
    """A factor with at most two decimals and no closing zeros."""
    return _known(x, ~F.isnan(x), F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", ""), F.lit("x")))


def shown(text):
    return F.coalesce(F.when(F.trim(text) != "", F.trim(text)), F.lit(DASH))


def yes_no(flag):
    return F.when(flag, "yes").when(~flag, "no").otherwise(DASH)


def progress(value, start, span):
    """Share of a span that lies before value, from 0 to 1; an empty span: 0."""
    return F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - start) / span))).otherwise(0.0)


def disposition(hidden, protected, rects):
    """What becomes of a frame: excluded windows first, then protected content, then frames without changes."""
    return F.when(hidden, "excluded").when(protected, "protected").when(rects == 0, "unchanged").otherwise("recorded")
