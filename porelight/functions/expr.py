"""Scalar expressions as columns, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for a missing member.
UNKNOWN, ABASIC_NOT_SET, GAP = "?", 2, -1
MAX_QUALITY, QUALITY_BITS = 31, 5


def time_to_int(seconds: Column, rate: Column) -> Column:
    """Seconds to samples, towards zero."""
    return (seconds * rate).cast("bigint")


def time_to_float(samples: Column, rate: Column) -> Column:
    """Samples to seconds at the middle of the sample; lengths are treated alike."""
    return (samples + F.lit(0.5)) / rate


def to_current(sample: Column, digitisation: Column, offset: Column, span: Column) -> Column:
    """A raw sample in picoampere, evaluated in double and narrowed at the end."""
    return ((sample + offset) * span / digitisation).cast("float")


def split_fastq(fq: Column) -> Column:
    """(name, bases, comment, quality); four empty strings unless there are three line ends."""
    lines = F.split(fq, "\n")
    part = lambda k, skip: F.when(F.size(lines) >= 4, F.substring(F.get(lines, F.lit(k)), 1 + skip, 1 << 30)).otherwise("")
    return F.struct(part(0, 1).alias("name"), part(1, 0).alias("bases"), part(2, 1).alias("comment"), part(3, 0).alias("quality"))


def fastq_bases(fq: Column) -> Column:
    lines = F.split(fq, "\n")
    return F.when(F.size(lines) >= 4, F.get(lines, F.lit(1))).otherwise("")


def build_fastq(name: Column, bases: Column, quality: int = 33) -> Column:
    """A record with one quality for every base."""
    return F.concat(F.lit("@"), name, F.lit("\n"), bases, F.lit("\n+\n"), F.repeat(F.lit(chr(quality)), F.length(bases)), F.lit("\n"))


def masked_quality(character: Column, bits: int = QUALITY_BITS) -> Column:
    """Phred value of a quality character, capped, with only the top ``bits`` of five kept."""
    mask = (1 << QUALITY_BITS) - (1 << (QUALITY_BITS - bits))
    return F.least(F.ascii(character) - 33, F.lit(MAX_QUALITY)).bitwiseAND(F.lit(mask))


def quantise(p: Column, bits: int) -> Column:
    return F.least(F.floor(p * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")


def dequantise(v: Column, bits: int) -> Column:
    return v / float(1 << bits)


def as_time(samples: Column, rate: Column) -> Column:
    """h:mm:ss.mmm; 'nan' for NaN."""
    t = samples / rate
    whole = lambda x: x.cast("bigint")
    text = F.format_string("%d:%02d:%02d.%03d", whole(t / 3600), whole(t / 60) % 60, whole(t) % 60, whole(t * 1000) % 1000)
    return F.when(F.isnan(t), "nan").otherwise(text)


def start_time_of(text: Column) -> Column:
    """An experiment's start: ISO text if it holds a T, seconds since the epoch otherwise."""
    return F.when(F.contains(text, F.lit("T")), F.try_to_timestamp(text)).otherwise(F.timestamp_seconds(F.try_to_number(text, F.lit("999999999999"))))


def bases_per_second(bases: Column, seconds: Column) -> Column:
    return F.format_string("%.2f", F.when(seconds < 1e-3, F.lit(float("nan"))).otherwise(bases / seconds))


def event_stdv(stdv: Column | None, variance: Column | None) -> Column:
    """Whichever member there is; neither is an error."""
    if stdv is None and variance is None:
        raise ValueError("events have neither stdv nor variance")
    return stdv if stdv is not None else F.sqrt(variance)


def kmer_at(bases: Column, position: Column, k: Column | int) -> Column:
    """The ``k`` bases at a position counted from 0."""
    return bases.substr((position + 1).cast("int"), F.lit(k) if isinstance(k, int) else k)


def find_kmer(bases: Column, kmer: Column, position: Column) -> Column:
    """Leftmost place of ``kmer`` at ``position`` or later; -1 if there is none."""
    return F.when(position < F.length(bases), F.call_function("locate", kmer, bases, (position + 1).cast("int")) - 1).otherwise(-1)


def is_homopolymer(kmer: Column) -> Column:
    return kmer == F.call_function("repeat", F.substring(kmer, 1, 1), F.length(kmer))


def text_to_nul(column: Column) -> Column:
    """A fixed-length string up to its first NUL."""
    return F.substring_index(column, "\0", 1)


def six_digits(x: Column) -> Column:
    """A double as the attribute maps write it, with six significant digits."""
    text = F.format_string("%.5e", x)
    digits = F.coalesce(F.regexp_extract(text, r"e(.+)$", 1).try_cast("int"), F.lit(0))  # after rounding
    scientific = (digits < -4) | (digits >= 6)
    mantissa = F.regexp_replace(F.regexp_replace(text, r"e.*", ""), r"\.?0+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.call_function("printf", F.concat(F.lit("%."), F.greatest(5 - digits, F.lit(0)).cast("string"), F.lit("f")), x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when(scientific, F.concat(mantissa, F.regexp_replace(text, r"^[^e]*", ""))).otherwise(plain)


def have_channel(channel: Column) -> Column:
    return F.coalesce(channel["sampling_rate"], F.lit(0.0)) > 0


def with_defaults(params: Column) -> Column:
    """Detected-event params with the defaults of missing members."""
    return params.withField("median_before", F.coalesce(params["median_before"], F.lit(float("nan")))).withField("abasic_found", F.coalesce(params["abasic_found"], F.lit(ABASIC_NOT_SET))).withField("read_id", F.coalesce(params["read_id"], F.lit("")))


def caller_of(attrs: Column) -> Column:
    """(name, version) of the program that wrote a basecall group, from its attribute map."""
    get = lambda k: F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit(UNKNOWN))
    program = F.try_element_at(attrs, F.lit("name"))
    name = F.when(program == "ONT Sequencing Workflow", "metrichor").when(program == "MinKNOW-Live-Basecalling", "minknow").when(program == "ONT Albacore Sequencing Software", "albacore").otherwise(UNKNOWN)
    version = F.when(name == "metrichor", F.concat(get("chimaera version"), F.lit("+"), get("dragonet version"))).when(name == UNKNOWN, UNKNOWN).otherwise(get("version"))
    return F.struct(name.alias("name"), version.alias("version"))
