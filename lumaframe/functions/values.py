"""Flags, hashes, boxes, times, sizes and texts of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe import schemas as S


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def set_then_clear(flags: Column, add: Column, clear: Column) -> Column:
    return flags.bitwiseOR(add).bitwiseAND(F.bitwise_not(clear))


def hash_long(text: Column) -> Column:
    """16 hex digits as a signed long; NULL for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 if they are apart or have no area."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = w * h
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def capture_time(name: Column) -> Column:
    """Time of capture from a file name: a date and time, else 13 digits of epoch milliseconds, else ''."""
    digits = F.regexp_extract(name, r"(20\d{6}[_-]\d{6})", 1)
    d = F.translate(digits, "_-", "")
    stamp = F.concat_ws(" ", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)), F.concat_ws(":", F.substring(d, 9, 2), F.substring(d, 11, 2), F.substring(d, 13, 2)))
    millis = F.regexp_extract(name, r"(?<![0-9])(1[0-9]{12})(?![0-9])", 1).try_cast("long")
    from_millis = F.when((millis > 1_000_000_000_000) & (millis < 4_000_000_000_000), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss"))
    return F.when(digits != "", stamp).otherwise(F.coalesce(from_millis, F.lit("")))


def shoot_time(key: Column, normalize_exif: bool = False) -> Column:
    """The time of a shoot key. Keys in the notation of EXIF (colons in the date) give NULL unless normalize_exif."""
    if normalize_exif:
        key = F.regexp_replace(key, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    return F.try_to_timestamp(key, F.lit("yyyy-MM-dd HH:mm:ss"))


def megabytes(size: Column) -> Column:
    """Bytes as megabytes with two decimals, rounded on the integer count (ties to even, as the exact value is a tie)."""
    scaled = size * 100
    whole = F.floor(scaled / F.lit(1 << 20)).cast("long")
    rest = scaled - whole * (1 << 20)
    up = (rest > (1 << 19)) | ((rest == (1 << 19)) & (whole % 2 == 1))
    cents = whole + up.cast("long")
    return F.concat(F.floor(cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def decision_text(decision: Column, unmarked: str = "未定") -> Column:
    return F.when(decision == S.KEEP, F.lit("保留")).when(decision == S.REJECT, F.lit("不保留")).otherwise(F.lit(unmarked))


def issue_texts(flags: Column, detail: Column) -> Column:
    """What is wrong with a file, in a fixed order; an exposure names its direction if the detail knows it."""
    over = F.get_json_object(detail, "$.exposure.over") == "true"
    under = F.get_json_object(detail, "$.exposure.under") == "true"
    exposure = F.when(over, F.lit("过曝")).when(under, F.lit("欠曝")).otherwise(F.lit("曝光"))
    # The texts of the detector bits, in the order in which they are listed.
    texts = [(S.CORRUPTED, "损坏"), (S.DUP, "重复"), (S.BLANK, "空镜"), (S.LENS_DIRT, "镜头脏污"), (S.BLUR, "模糊"), (S.EXPOSURE, exposure), (S.NOISE, "噪点"), (S.SHAKE, "抖动")]
    found = F.filter(F.array(*[F.when(has(flags, bit), F.lit(t) if isinstance(t, str) else t) for bit, t in texts]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("未知"))).otherwise(found)


def detail_json(detail: Column) -> Column:
    """A detail struct as JSON; absent members are left out."""
    return F.to_json(detail)


def parsed_detail(text: Column) -> Column:
    return F.from_json(text, S.DETAIL)


def claim_millis(t: Column) -> Column:
    """Older claims are in seconds: a positive time under 10**12 is scaled, once."""
    return F.when((t > 0) & (t < 1_000_000_000_000), t * 1000).otherwise(t)


def fitted(w: Column, h: Column, short_side: int, even: bool = False) -> Column:
    """struct(w, h, need): the size whose short side is short_side; never larger than it was."""
    short = F.least(w, h)
    need = (w > 0) & (h > 0) & (short > short_side)
    least = 2 if even else 1

    def side(x: Column) -> Column:
        scaled = F.floor(x * (F.lit(float(short_side)) / short) + 0.5).cast("long")
        return F.greatest(scaled - scaled % 2 if even else scaled, F.lit(least).cast("long"))

    return F.struct(F.when(need, side(w)).otherwise(w.cast("long")).alias("w"), F.when(need, side(h)).otherwise(h.cast("long")).alias("h"), need.alias("need"))


def detail_size(w: Column, h: Column) -> Column:
    """struct(w, h) for sharpness and noise: the long side at most DETAIL_SIDE, never under 8 when scaled."""
    long = F.greatest(w, h)

    def side(x: Column) -> Column:
        return F.greatest(F.floor(x * (F.lit(float(S.DETAIL_SIDE)) / long) + 0.5).cast("long"), F.lit(8).cast("long"))

    unknown = (w <= 0) | (h <= 0)
    return F.struct(*[F.when(unknown, F.lit(S.DETAIL_SIDE).cast("long")).when(long <= S.DETAIL_SIDE, x.cast("long")).otherwise(side(x)).alias(n) for n, x in (("w", w), ("h", h))])


IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
IPV6 = r"(?i)^(?=[0-9a-f:.]*:[0-9a-f:.]*$)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)(?!.*::.*::)(?:[0-9a-f]{1,4}:)*(?:[0-9a-f]{1,4})?::(?:[0-9a-f]{1,4}:)*(?:[0-9a-f]{1,4})?)$"


def is_ip(text: Column) -> Column:
    return text.rlike(IPV4) | text.rlike(IPV6)


def is_inner(ip: Column) -> Column:
    """Loopback and private addresses."""
    octet = [F.split(ip, r"\.")[k].try_cast("int") for k in range(2)]
    four = (octet[0] == 10) | (octet[0] == 127) | ((octet[0] == 172) & octet[1].between(16, 31)) | ((octet[0] == 192) & (octet[1] == 168))
    return F.when(ip.rlike(IPV4), four).when(ip.rlike(IPV6), ip.rlike("(?i)^(::1|f[cd][0-9a-f]{2}:.*)$")).otherwise(F.lit(False))


def client_ip(peer: Column, forwarded: Column, real: Column) -> Column:
    """The client behind a proxy: headers count only if the peer is an inner address."""
    host = F.when(peer.rlike(r"^\[.*\]:\d+$"), F.regexp_extract(peer, r"^\[(.*)\]:\d+$", 1)).when(peer.rlike(r"^[^:]+:\d+$"), F.substring_index(peer, ":", 1)).otherwise(peer)
    first = F.trim(F.split(F.coalesce(forwarded, F.lit("")), ",")[0])
    nearest = F.trim(F.coalesce(real, F.lit("")))
    return F.when(is_inner(host) & is_ip(first), first).when(is_inner(host) & is_ip(nearest), nearest).otherwise(host)
