"""Scalar rules as column expressions. All arithmetic on counts and ticks is whole-numbered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger.plans.scan import idiv

# Fixed values.
OUTPUT_SUFFIX = ".h265.mov"
MAX_FPS_DEN = 1_000_000
MAX_FPS_NUM = 2_000_000
MAX_SAMPLE_RATE = 384_000
DEFAULT_SAMPLE_RATE = 48_000
AUDIO_BITS = 24
BYTES_PER_SAMPLE = 3
SEGMENT_SECONDS = 10
SEGMENT_FALLBACK = 600
DEFAULT_PACKET_SAMPLES = 4800


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def strip_extension(path) -> Column:
    """Drop the extension: the last dot counts only after the last slash."""
    return F.regexp_replace(_c(path), r"\.[^./]*$", "")


def default_output(path, suffix: str = OUTPUT_SUFFIX) -> Column:
    return F.concat(strip_extension(path), F.lit(suffix))


def round_half_up(value, digits: int) -> Column:
    """Round to ``digits`` places with plain double steps, the same on every engine."""
    scale = float(10**digits)
    return F.floor(_c(value) * scale + 0.5) / scale


def auto_keyint(fps_num, fps_den, keyint=None) -> Column:
    """Key interval: the one set, else two seconds of frames, at least 1."""
    guess = F.floor(_c(fps_num) / _c(fps_den) * 2.0 + 0.5).cast("bigint")
    guess = F.greatest(guess, _long(1))
    if keyint is None:
        return guess
    return F.when(_c(keyint) > 0, _c(keyint).cast("bigint")).otherwise(guess)


def segment_frames(rate_text) -> Column:
    """Frames in ten seconds of a ``num/den`` rate, at least 1; 600 when the rate is unusable.

    A denominator of a single digit counts as unusable, as in the tool this rule comes from.
    """
    pair = parse_rational(rate_text)
    usable = _c(rate_text).rlike(r"^[0-9]+/[1-9][0-9]+$")
    frames = idiv(pair.num * SEGMENT_SECONDS + idiv(pair.den, _long(2)), pair.den)
    return F.when(usable, F.greatest(frames, _long(1))).otherwise(_long(SEGMENT_FALLBACK))


class Rational:
    def __init__(self, num: Column, den: Column):
        self.num, self.den = num, den


def parse_rational(text) -> Rational:
    """``num/den`` text as two whole numbers, both null when the text is not of that form."""
    whole = F.regexp_extract(_c(text), r"^([0-9]+)/([0-9]+)$", 1)
    below = F.regexp_extract(_c(text), r"^([0-9]+)/([0-9]+)$", 2)
    as_long = lambda part: F.nullif(part, F.lit("")).try_cast("bigint")
    return Rational(as_long(whole), as_long(below))


def fmt_duration(seconds) -> Column:
    """``MM:SS``, or ``H:MM:SS`` from one hour. Negative counts as 0, halves round up."""
    s = F.floor(F.greatest(_c(seconds).cast("double"), F.lit(0.0)) + 0.5).cast("bigint")
    hours, minutes, rest = idiv(s, _long(3600)), idiv(s % 3600, _long(60)), s % 60
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    short = F.concat(two(minutes), F.lit(":"), two(rest))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def packet_duration(is_video, size, fps_den, channels) -> Column:
    """Ticks a packet lasts: one frame for video, whole samples per channel for audio.

    Audio of unknown channels lasts a fixed number of samples.
    """
    per = (_c(channels) * BYTES_PER_SAMPLE).cast("bigint")
    return (
        F.when(_c(is_video), _c(fps_den).cast("bigint"))
        .when(per > 0, idiv(_c(size), per))
        .otherwise(_long(DEFAULT_PACKET_SAMPLES))
    )


def frame_pts(frame_no, fps_den) -> Column:
    return _c(frame_no) * _c(fps_den)


def frame_sample_target(frame_no, sample_rate, fps_num, fps_den) -> Column:
    """Audio samples due by the end of a frame."""
    return idiv((_c(frame_no) + 1) * _c(sample_rate) * _c(fps_den), _c(fps_num))


def sample_frame(sample, sample_rate, fps_num, fps_den) -> Column:
    """First frame whose target is above ``sample``: the inverse of the line above, no join."""
    per = _c(sample_rate) * _c(fps_den)
    return idiv((_c(sample) + 1) * _c(fps_num) + per - 1, per) - 1


def sha256_text(text) -> Column:
    """Lower-case hex SHA-256; the empty string when there is nothing to read."""
    return F.coalesce(F.sha2(_c(text), 256), F.lit(""))


def json_first(doc, keys: list[str]) -> Column:
    """First value of the first key that occurs in a JSON text; earlier keys go first.

    The top level is asked first, then the first place in the text where it is a key and not part
    of a value. Null, false and the empty text count as absent.
    """
    found = []
    for key in keys:
        top = F.get_json_object(_c(doc), f"$['{key}']")
        # A quote inside a value has a backslash in front.
        value = F.regexp_extract(
            _c(doc), rf'(?<!\\)"{key}"\s*:\s*("(?:[^"\\]|\\.)+"|-?[0-9][0-9.eE+-]*|true)', 1
        )
        inner = F.get_json_object(F.concat(F.lit('{"v":'), F.nullif(value, F.lit("")), F.lit("}")), "$.v")
        found += [F.nullif(F.nullif(top, F.lit("")), F.lit("false")), inner]
    return F.coalesce(*found)


def json_has(doc, key: str) -> Column:
    """True when the key occurs at the top of the JSON text, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(doc)), key), F.lit(False))


def six_digits(value) -> Column:
    """A number with six significant digits; null when it is not finite."""
    v = _c(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.format_string("%.5e", v).cast("double"))


def lens_text(code) -> Column:
    return F.when(_c(code) == 1, "on").when(_c(code) == 2, "off").otherwise("auto")


def meta_value(meta, key: str) -> Column:
    """Value of the first ``[key, value]`` pair with that key."""
    hits = F.filter(_c(meta), lambda pair: pair[0] == key)
    return F.get(hits, F.lit(0))[1]


def meta_map(meta) -> Column:
    """Pairs as a map; the first pair of a key wins."""
    names = F.array_distinct(F.transform(_c(meta), lambda pair: pair[0]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.get(F.filter(_c(meta), lambda p: p[0] == n), F.lit(0))[1]),
    )
