"""Scalar functions as Column builders: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_SIZE = 1 << 18
HIT_CAP = 0x1FFFFFFF
RARE_TARGET_HITS, CRITICAL_HITS = 100_000, 200
MOST_FACTOR, MOST_SCORE = 32, 1600


def div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def raw_score(flagged: Column, lines: Column, run_tools: Column, all_tools: Column, w_flags: float = 0.5, w_tools: float = 0.5) -> Column:
    return F.lit(w_flags) * div(flagged, lines) + F.lit(w_tools) * div(run_tools, all_tools)


def round3(x: Column) -> Column:
    """Half-even on the exact binary value, three places, for values below a thousand."""
    return F.format_number(x, 3).cast("double")


def scale(x: Column, min_x, max_x, min_y, max_y) -> Column:
    """Linear rescale; null where the source range is empty."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.try_divide(lit(max_y) - lit(min_y), lit(max_x) - lit(min_x)) * (x - lit(min_x)) + lit(min_y)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def joined_set(x: Column, sep: str = "-") -> Column:
    """Aggregate: the distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(x)), sep)


def label(vuln: Column, line: Column) -> Column:
    return F.concat_ws(":", vuln, line.cast("string"))


def hit_bucket(n: Column) -> Column:
    """Hit counts as one of eight bits: 1, 2, 3, 4-7, 8-15, 16-31, 32-127, 128 and more."""
    out = F.lit(128)
    for below, bit in ((128, 64), (32, 32), (16, 16), (8, 8), (4, 4), (3, 2), (2, 1), (1, 0)):
        out = F.when(n < below, bit).otherwise(out)
    return out


def hit_bucket_human(n: Column) -> Column:
    """The same classes as 0 to 8."""
    out = F.lit(8)
    for below, c in ((128, 7), (32, 6), (16, 5), (8, 4), (4, 3), (3, 2), (2, 1), (1, 0)):
        out = F.when(n < below, c).otherwise(out)
    return out


def edge_only(n: Column) -> Column:
    return (n > 0).cast("int")


def simplified(n: Column) -> Column:
    """1 for an absent edge, 128 for one that was hit."""
    return F.when(n > 0, 128).otherwise(1)


def num_equal_bits(a: Column, b: Column) -> Column:
    return F.bit_count(F.bitwise_not(a.cast("long").bitwiseXOR(b.cast("long"))))


def trace_checksum(pairs: Column) -> Column:
    """A 64-bit checksum of an array of (edge, class) structs, whatever its order."""
    return F.xxhash64(F.array_sort(pairs))


def next_p2(x: Column) -> Column:
    """The least power of two that isn't below x; 1 up to 1."""
    bits = F.length(F.regexp_replace(F.bin((x - 1).cast("long")), "^0+", ""))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def linear_cycle_interval(init: Column, step: Column) -> Column:
    return init + step


def log_cycle_interval(init: Column, seconds: Column) -> Column:
    """init + trunc(150 log2(hours + 1))."""
    return (init + F.floor(F.log2(seconds / F.lit(3600.0) + 1) * 150)).cast("long")


def dist_factor(default: Column, vuln: Column) -> Column:
    return F.lit(0.5) * default + F.lit(0.5) * vuln


def difficulty_factor(difficulty: Column, step: int = 5, default: int = 1) -> Column:
    return F.least(difficulty / F.lit(step) + F.lit(default), F.lit(float(default)))


def raw_distance(d: Column) -> Column:
    """100 d; what lies between 0 and 1 becomes 1."""
    x = d * 100
    return F.when((x > 0) & (x < 1), 1.0).otherwise(x)


def cooling(progress: Column, schedule: str) -> Column:
    """Temperature at ``progress`` (1: the time to exploitation is over)."""
    if schedule == "exp":
        return 1 / F.pow(F.lit(20.0), progress)
    if schedule == "log":
        return 1 / (1 + 2 * F.log(1 + progress * F.lit(13358.7268297)))
    if schedule == "lin":
        return 1 / (1 + 19 * progress)
    if schedule == "quad":
        return 1 / (1 + 19 * progress * progress)
    raise ValueError(f"no cooling schedule {schedule!r}")


def _human(n: Column, base: int, units: str, gap: str, tail: str) -> Column:
    """About three digits and a unit: whole numbers up to 9999, then one decimal below 99.95 of the first unit, two below 9.995 and one below 99.95 of the others, whole units below a thousand."""
    out = F.when(n < 10_000, F.concat(n.cast("string"), F.lit(gap + tail if tail else "")))
    for i, unit in enumerate(units):
        size, x = base ** (i + 1), n / F.lit(float(base ** (i + 1)))
        steps = [(9.995, F.format_string("%.2f", x))] * (i > 0) + [(99.95, F.format_string("%.1f", x))]
        steps += [(1000.0, F.floor(n / F.lit(size)).cast("string"))] * (i < len(units) - 1)
        for below, text in steps:
            out = out.when(n < F.lit(float(size)) * F.lit(below), F.concat(text, F.lit(gap + unit + tail)))
    return out.otherwise("infty")


def human_count(n: Column) -> Column:
    """A count in about five characters: 9999, 12.3k, 4.56M and so on."""
    return _human(n, 1000, "kMGT", "", "")


def human_size(n: Column) -> Column:
    """A number of bytes: 9999 B, 12.3 kB, 4.56 MB and so on."""
    return _human(n, 1024, "kMGT", " ", "B")


def human_number(x: Column) -> Column:
    """A fraction: two decimals below a hundred, one below a thousand, else a count."""
    return F.when(x < 99.995, F.format_string("%.2f", x)).when(x < 999.95, F.format_string("%.1f", x)).otherwise(human_count(F.floor(x)))


def human_time(now_ms: Column, event_ms: Column) -> Column:
    """How long ago an event was; ``none seen yet`` for 0."""
    s = F.floor((now_ms - event_ms) / 1000)
    parts = [human_count(F.floor(s / 86400)), *(F.floor(s / size % n).cast("string") for size, n in ((3600, 24), (60, 60), (1, 60)))]
    return F.when(event_ms == 0, "none seen yet").otherwise(F.concat(parts[0], F.lit(" days, "), parts[1], F.lit(" hrs, "), parts[2], F.lit(" min, "), parts[3], F.lit(" sec")))


def response_class(orig: Column, xff: Column, x01: Column, s10: Column, a10: Column) -> Column:
    """How a byte answers to four changes, by the traces' checksums: none, minor, fixed or variable."""
    same = [x == orig for x in (xff, x01, s10, a10)]
    every, some = same[0] & same[1] & same[2] & same[3], same[0] | same[1] | same[2] | same[3]
    return F.when(every, "none").when(some, "minor").when((xff == x01) & (xff == s10) & (xff == a10), "fixed").otherwise("variable")


def first_and_last_difference(a: Column, b: Column) -> Column:
    """(first, last) 0-based place at which two arrays of equal length differ, -1 if nowhere."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, F.lit(True)) - 1
    back = F.array_position(F.reverse(differ), F.lit(True))
    return F.struct(first.cast("int").alias("first"), F.when(back == 0, -1).otherwise(F.size(differ) - back).cast("int").alias("last"))


def operand_flags(width: Column, first: Column, second: Column) -> Column:
    """4: the operands are int32, 8: int64, by the fourth token of a condition's record; 2: the first operand is a constant (anything but ``var``), 1: the second is."""
    bit = lambda cond, v: F.when(cond, v).otherwise(0)
    return bit(width == "int32", 4) + bit(width == "int64", 8) + bit(first != "var", 2) + bit(second != "var", 1)


def operand_constant(operand: Column) -> Column:
    """The value of a constant operand: its leading decimal number, 0 without one; null for ``var``."""
    number = F.regexp_extract(operand, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when(operand != "var", F.coalesce(number, F.lit(0).cast("long")))


INPUT_FILE = r"INPUT_FILE:\s(.+)"
ERROR_LINE = r"ERROR:\s([^:]+):\s([a-zA-Z_-]+)"
FRAME_FULL = r"#([0-9]+).*in\s([a-zA-Z0-9_]+)\s([^:]+):([0-9]+)"
FRAME_FUNCTION = r"#([0-9]+).*in\s([a-zA-Z0-9_]+)"
FRAME_MODULE = r"#([0-9]+).*\(.+\)"


def frame_of(line: Column) -> Column:
    """The stack frame that a report line names, or null; what is unknown is "-" or -1."""

    def made(pattern: str, file: Column, function: Column, at: Column) -> Column:
        number = F.regexp_extract(line, pattern, 1).try_cast("int")
        return F.when(line.rlike(pattern), F.struct(number.alias("id"), file.alias("file"), function.alias("function"), at.alias("line")))

    dash, none = F.lit("-"), F.lit(-1)
    full = made(FRAME_FULL, basename(F.regexp_extract(line, FRAME_FULL, 3)), F.regexp_extract(line, FRAME_FULL, 2), F.regexp_extract(line, FRAME_FULL, 4).try_cast("int"))
    return F.coalesce(full, made(FRAME_FUNCTION, dash, F.regexp_extract(line, FRAME_FUNCTION, 2), none), made(FRAME_MODULE, dash, dash, none))


def encode_trace(trace: Column) -> Column:
    """``#id:file:function:line`` joined by "="."""
    return F.array_join(F.transform(trace, lambda f: F.concat(F.lit("#"), F.concat_ws(":", f["id"].cast("string"), f["file"], f["function"], f["line"].cast("string")))), "=")


def decode_trace(text: Column) -> Column:
    """The inverse of ``encode_trace``; an empty text is an empty trace."""

    def one(part: Column) -> Column:
        p = F.split(F.regexp_replace(part, "^#", ""), ":")
        return F.struct(p[0].cast("int").alias("id"), p[1].alias("file"), p[2].alias("function"), p[3].cast("int").alias("line"))

    return F.when(text == "", F.array().cast("array<struct<id:int,file:string,function:string,line:int>>")).otherwise(F.transform(F.split(text, "="), one))


def trace_key(trace: Column, n_frames: int | None = None, filepaths: bool = False, lines: bool = False) -> Column:
    """The first frames, reduced to what is compared: (id, function) and, where asked, file or line. With both the whole frame."""
    head = trace if n_frames is None else F.slice(trace, 1, n_frames) if n_frames > 0 else F.slice(trace, 1, 0)
    fields = ["id", *(["file"] if filepaths else []), "function", *(["line"] if lines else [])]
    return F.transform(head, lambda f: F.struct(*[f[c].alias(c) for c in fields]))
