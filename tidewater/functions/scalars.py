"""Scalar functions as Column expressions: all run inside the JVM, none is a UDF.

Numbers follow one rule throughout: a missing number counts as 0 where the
service that wrote the data would have used 0, and division by nothing gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x: C) -> Column:
    """x, or 0 for null and NaN."""
    return F.coalesce(F.nanvl(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def ratio(a: C, b: C) -> Column:
    """a / b, 0 where b is 0, negative or missing."""
    return F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(F.lit(0.0))


# -- routes, sizes and times ---------------------------------------------------


def normalize_route(url: C) -> Column:
    """H1: path without query; hashes, UUIDs and numeric segments replaced by names."""
    path = F.split(_c(url), r"\?").getItem(0)
    path = F.regexp_replace(path, "[0-9a-fA-F]{32,64}", ":hash")
    uuid = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
    path = F.regexp_replace(path, uuid, ":id")
    return F.regexp_replace(path, "/[0-9]+(/|$)", "/:id$1")


def mbps(bytes_per_second: C) -> Column:
    """H2: megabits per second."""
    return zero(bytes_per_second) * 8 / 1e6


#: Units of 1024, fixed by the output format.
UNITS = ("B", "KB", "MB", "GB", "TB")


def to_fixed(x: C, places: int) -> Column:
    """A number as text with a fixed number of decimals, rounded from its exact binary value."""
    return F.format_string(f"%.{places}f", _c(x).cast("decimal(38,18)"))


def _trimmed(x: Column) -> Column:
    """Two decimals without trailing zeros."""
    text = F.format_string("%.2f", x)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def format_bytes(n: C) -> Column:
    """H3: bytes in the largest unit, two decimals at most. 0 is '0 B'."""
    n = _c(n).cast("double")
    unit = F.least(F.floor(F.log(n) / F.log(F.lit(1024.0))), F.lit(len(UNITS) - 1)).cast("int")
    names = F.array(*(F.lit(u) for u in UNITS))
    return F.when(n == 0, "0 B").when(n > 0, F.concat(_trimmed(n / F.pow(F.lit(1024.0), unit)), F.lit(" "), F.get(names, unit)))


def format_duration(ms: C) -> Column:
    """H4: '1h 2m', '3m 4s' or '5s' from milliseconds."""
    s = F.floor(_c(ms) / 1000)
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def eta(state: C, total: C, downloaded: C, speed: C) -> Column:
    """H5: seconds left; -1 if not downloading or speed unknown, 0 when done."""
    rest = zero(total) - zero(downloaded)
    return F.when(F.coalesce(_c(state) != "downloading", F.lit(True)), -1).when(rest <= 0, 0).when(zero(speed) <= 0, -1).otherwise(F.ceil(rest / zero(speed))).cast("long")


def progress(total: C, downloaded: C, uploaded: C, speed: C) -> Column:
    """H6: struct of percentage (100 at most), eta (null if unknown) and share ratio."""
    rest = zero(total) - zero(downloaded)
    left = F.when((zero(speed) > 0) & (rest > 0), F.ceil(rest / zero(speed)).cast("long"))
    return F.struct(F.least(F.lit(100.0), ratio(zero(downloaded), zero(total)) * 100).alias("percentage"), left.alias("eta"), ratio(zero(uploaded), zero(downloaded)).alias("ratio"))


def swarm_health(seeds: C, total: C, connected: C) -> Column:
    """H7: seven tenths by share of seeds, three tenths by connections up to 50."""
    return F.when(zero(total) > 0, 0.7 * zero(seeds) / zero(total) + 0.3 * F.least(F.lit(1.0), zero(connected) / 50)).otherwise(0.0)


def average_speed(size: C, ms: C) -> Column:
    """H8: bytes per second over a duration in milliseconds."""
    return ratio(_c(size), _c(ms) / 1000)


# -- digests, names, pieces ----------------------------------------------------


def sha1_hex(x: C) -> Column:
    return F.sha1(_c(x).cast("binary"))


def sha256_hex(x: C) -> Column:
    """H9."""
    return F.sha2(_c(x).cast("binary"), 256)


def normalize_info_hash(x: C) -> Column:
    """40 lower-case hex digits from hex text; null otherwise. Binary hashes go through lower(hex(x))."""
    return F.when(_c(x).rlike("^[0-9a-fA-F]{40}$"), F.lower(_c(x)))


def percent_encode(data: C) -> Column:
    """Bytes percent-encoded but for the unreserved characters of URLs."""
    pairs = F.regexp_extract_all(F.hex(_c(data)), F.lit("([0-9A-F]{2})"), F.lit(1))
    plain = lambda h: F.chr(F.conv(h, 16, 10).cast("int"))
    encoded = F.transform(pairs, lambda h: F.when(plain(h).rlike(r"^[A-Za-z0-9._~\-]$"), plain(h)).otherwise(F.concat(F.lit("%"), h)))
    return F.array_join(encoded, "")


def sanitize_name(name: C) -> Column:
    """Trimmed, characters that file systems refuse replaced, white space collapsed, 255 characters."""
    clean = F.regexp_replace(F.trim(_c(name)), r'[/\\:*?"<>|]', "_")
    return F.substring(F.regexp_replace(clean, r"\s+", " "), 1, 255)


def safe_file_name(path: C) -> Column:
    """Last element of a path, anything but letters, digits, '.', '_' and '-' replaced."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), "[^a-zA-Z0-9._-]", "_")


KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
#: Upper file size and piece size of each step; fixed values of the format's producer.
PIECE_LADDER = ((64 * MIB, 256 * KIB), (512 * MIB, 512 * KIB), (2 * GIB, MIB))
LARGEST_PIECE = 2 * MIB
PIECE_RANGE = (16 * KIB, 8 * MIB)


def piece_size(size: C, requested: C | None = None) -> Column:
    """Piece length by file size; a requested one is taken if within range and null otherwise."""
    step = None
    for below, length in PIECE_LADDER:
        step = F.when(_c(size) < below, length) if step is None else step.when(_c(size) < below, length)
    own = step.otherwise(LARGEST_PIECE).cast("long")
    if requested is None:
        return own
    asked = _c(requested)
    return F.when(asked.isNull(), own).when(asked.between(*PIECE_RANGE), asked.cast("long"))


def piece_count(size: C, length: C) -> Column:
    """Number of pieces."""
    return F.ceil(_c(size) / _c(length)).cast("long")


def piece_length(index: C, size: C, length: C) -> Column:
    """Length of piece index; the last one is what remains."""
    return F.greatest(F.lit(0), F.least(_c(length), _c(size) - _c(index) * _c(length))).cast("long")


BLOCK = 16 * KIB


def blocks(length: C, block: int = BLOCK) -> Column:
    """Array of (offset, length) blocks of a piece, the last one short."""
    n = F.ceil(_c(length) / block)
    at = F.when(n > 0, F.sequence(F.lit(0), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(at, lambda i: F.struct((i * block).alias("offset"), F.least(F.lit(block).cast("long"), _c(length) - i * block).alias("length")))


def piece_range(start: C, end: C, length: C) -> Column:
    """First and last piece that hold bytes start..end of a file."""
    return F.struct(F.floor(_c(start) / _c(length)).alias("first"), F.floor((_c(end) - 1) / _c(length)).alias("last"))


def overlap(a0: C, a1: C, b0: C, b1: C) -> Column:
    """Bytes that [a0, a1) and [b0, b1) share."""
    return F.greatest(F.lit(0), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))


def file_progress(done: C, total: C, size: C) -> Column:
    """Bytes of a file by its share of completed pieces, rounded down."""
    return F.floor(ratio(_c(done), _c(total)) * _c(size)).cast("long")


# -- bits ------------------------------------------------------------------


def bit_set(bitfield: C, index: C) -> Column:
    """Whether piece index is set; the first piece is the highest bit of the first byte."""
    byte = F.conv(F.hex(F.substring(_c(bitfield), (F.floor(_c(index) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.call_function("shiftright", byte, (F.lit(7) - _c(index) % 8).cast("int")).bitwiseAND(1) == 1), F.lit(False))


def bitfield_hex(done: C, count: C) -> Column:
    """Bitfield of count pieces as hex, from the array of completed indices."""
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, i: acc * 2 + F.when(F.array_contains(_c(done), (b * 8 + i).cast("int")), 1).otherwise(0))
    index = F.sequence(F.lit(0), F.ceil(_c(count) / 8).cast("int") - 1)
    return F.when(_c(count) > 0, F.array_join(F.transform(index, lambda b: F.lpad(F.hex(byte(b)), 2, "0")), "")).otherwise("")


def tri_state(done: C, active: C, count: C) -> Column:
    """2 for completed, 1 for active and 0 for missing pieces, in order."""
    index = F.when(_c(count) > 0, F.sequence(F.lit(0), _c(count).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.when(F.array_contains(_c(done), i), 2).when(F.array_contains(_c(active), i), 1).otherwise(0))


def extension_bit(reserved: C) -> Column:
    """The extension flag of eight reserved handshake bytes."""
    return F.conv(F.hex(F.substring(_c(reserved), 6, 1)), 16, 10).cast("int").bitwiseAND(0x10) != 0


# -- 160-bit identifiers -----------------------------------------------------

WORDS = 5


def id_words(hex_id: C) -> list[Column]:
    """A 160-bit hex id as five 32-bit words, highest first."""
    return [F.conv(F.substring(_c(hex_id), 8 * i + 1, 8), 16, 10).cast("long") for i in range(WORDS)]


def xor_words(a: C, b: C) -> list[Column]:
    """XOR distance as words; compared word by word they order like the distance."""
    return [x.bitwiseXOR(y) for x, y in zip(id_words(a), id_words(b), strict=True)]


def bucket_index(a: C, b: C) -> Column:
    """159 less the leading zero bits of the distance, 0 for equal ids."""
    out = F.lit(0)
    for i, w in reversed(list(enumerate(xor_words(a, b)))):
        out = F.when(w > 0, 32 * (WORDS - 1 - i) + F.length(F.bin(w)) - 1).otherwise(out)
    return out.cast("int")


def token(ip: C, secret: C) -> Column:
    """The first eight bytes, in hex, of SHA-1 over address and secret."""
    return F.substring(F.sha1(F.concat(_c(ip), _c(secret)).cast("binary")), 1, 16)


def token_valid(given: C, ip: C, secret: C, previous: C) -> Column:
    return F.coalesce((_c(given) == token(ip, secret)) | (_c(given) == token(ip, previous)), F.lit(False))


# -- errors, retries -----------------------------------------------------------

#: Substrings that decide a connection error's category, in order of precedence (fixed values).
CONNECTION_ERRORS = (
    ("timeout", ("timeout",)),
    ("protocol_error", ("protocol", "invalid", "pstrlen")),
    ("handshake_failed", ("info hash", "hash mismatch")),
    ("connection_reset", ("reset", "econnreset", "epipe")),
)
#: What is done about a category (fixed values).
ERROR_ACTIONS = {"protocol_error": "skip", "hash_mismatch": "retry", "timeout": "retry", "connection_reset": "retry", "handshake_failed": "skip"}
RECOVERY_ACTIONS = {"tracker": "retry", "peer": "skip", "filesystem": "pause", "verification": "retry", "metadata": "abort"}


def _any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def error_category(message: C) -> Column:
    """Category of a connection error; connection_reset unless something else is said."""
    text = F.lower(_c(message))
    out = None
    for name, parts in CONNECTION_ERRORS:
        test = _any_of(text, parts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("connection_reset")


def _looked_up(key: Column, known: dict[str, str], other: str) -> Column:
    out = None
    for k, v in known.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def error_action(category: C, timeouts: C | None = None) -> Column:
    """Retry or skip; the fourth timeout and later ones are skipped."""
    out = _looked_up(_c(category), ERROR_ACTIONS, "skip")
    return out if timeouts is None else F.when((_c(category) == "timeout") & (_c(timeouts) > 3), "skip").otherwise(out)


def error_code(category: C, message: C) -> Column:
    """Code of a transfer error, by category and what the message says."""
    text, kind = F.lower(_c(message)), _c(category)
    tracker = F.when(_any_of(text, ["timeout"]), "TRACKER_TIMEOUT").when(_any_of(text, ["404", "not found"]), "TRACKER_NOT_FOUND").otherwise("TRACKER_ERROR")
    disk = F.when(_any_of(text, ["enospc"]), "DISK_FULL").when(_any_of(text, ["eacces"]), "PERMISSION_DENIED").otherwise("FILESYSTEM_ERROR")
    return F.when(kind == "tracker", tracker).when(kind == "peer", "PEER_ERROR").when(kind == "filesystem", disk).when(kind == "verification", "HASH_MISMATCH").otherwise("UNKNOWN_ERROR")


def recovery_action(category: C) -> Column:
    return _looked_up(_c(category), RECOVERY_ACTIONS, "retry")


#: Status texts that decide about a retry (fixed values).
RETRY_TEXTS = ("econnrefused", "enotfound", "etimedout", "500", "502", "503", "504")
FINAL_TEXTS = ("400", "404", "403")
TRANSIENT_CODES = ("ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "NETWORK_ERROR", "REQUEST_TIMED_OUT")


def retryable(message: C) -> Column:
    """Network and server errors are tried again, client errors are not, others are."""
    text = F.lower(_c(message))
    return F.when(_any_of(text, RETRY_TEXTS), True).otherwise(~_any_of(text, FINAL_TEXTS))


def transient(message: C) -> Column:
    return _any_of(_c(message), TRANSIENT_CODES)


def backoff(attempt: C, base: float, multiplier: float, cap: float, jitter: C | None = None) -> Column:
    """Delay of an attempt; jitter in -1..1 moves it by a fifth."""
    delay = F.lit(float(base)) * F.pow(F.lit(float(multiplier)), _c(attempt))
    if jitter is not None:
        delay = delay * (1 + 0.2 * _c(jitter))
    return F.least(delay, F.lit(float(cap)))


# -- files and peers -----------------------------------------------------------

#: File types that pass without remark, and those that are executable (fixed values).
COMMON_TYPES = ".pdf .doc .docx .xls .xlsx .ppt .pptx .txt .md .csv .json .xml .mp3 .mp4 .mkv .avi .mov .wav .flac .ogg .jpg .jpeg .png .gif .webp .svg .zip .tar .gz .rar .7z .js .ts .py .html .css .epub .iso".split()
EXECUTABLE_TYPES = ".exe .dll .bat .sh .cmd .msi .deb .rpm .apk .dmg .pkg".split()


def extension(name: C) -> Column:
    """Lower-case extension with its dot; empty for none and for names that only begin with a dot."""
    base = F.element_at(F.split(_c(name), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def file_warnings(name: C) -> Column:
    """Array of codes: executable, uncommon or no_extension."""
    e = extension(name)
    known = COMMON_TYPES + EXECUTABLE_TYPES
    return F.array_compact(F.array(F.when(e.isin(EXECUTABLE_TYPES), F.lit("executable")), F.when((e != "") & ~e.isin(known), F.lit("uncommon")), F.when(e == "", F.lit("no_extension"))))


def peer(text: C) -> Column:
    """Struct of ip and port from 'ip:port'; null unless the port lies in 1..65535."""
    ip = F.regexp_extract(_c(text), r"^(.+):([0-9]+)$", 1)
    port = F.regexp_extract(_c(text), r"^(.+):([0-9]+)$", 2).try_cast("int")
    return F.when((ip != "") & port.between(1, 65535), F.struct(ip.alias("ip"), port.alias("port")))


def short_hash(x: C) -> Column:
    """First 12 characters, as metric labels use them."""
    return F.substring(_c(x), 1, 12)


def seeding_limit(share: C, minutes: C, idle: C, max_ratio: float, max_minutes: float, max_idle: float) -> Column:
    """Which limit ends seeding, in this order; a limit of 0 is none."""
    out = F.lit(None).cast("string")
    for value, limit, name in ((idle, max_idle, "idle_limit"), (minutes, max_minutes, "time_limit"), (share, max_ratio, "ratio_limit")):
        out = F.when(_c(value) >= limit, name).otherwise(out) if limit > 0 else out
    return out


def display_name(name: C, info_hash: C) -> Column:
    """The last path element of a name, else the hash's first eight digits."""
    last = F.element_at(F.split(_c(name), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) != "", last).otherwise(F.concat(F.lit("Magnet-"), F.substring(_c(info_hash), 1, 8)))


def percent_text(part: C, whole: C) -> Column:
    """D27, H48: 'x.y%', '0.0%' of nothing."""
    return F.concat(F.format_string("%.1f", ratio(_c(part), _c(whole)) * 100), F.lit("%"))


def from_millis(ms: C) -> Column:
    """Timestamp of epoch milliseconds."""
    return F.timestamp_millis(_c(ms).cast("long"))


def iso(ts: C) -> Column:
    """ISO text in UTC with milliseconds."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# -- compact addresses -------------------------------------------------------


def _once(value: Column, use) -> Column:
    """use(value), value being worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _number(data: Column, at: Column, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(width))), 16, 10).cast("int")


def _address(data: Column, at: Column) -> tuple[Column, Column]:
    parts = [_number(data, at + i, 1).cast("string") for i in range(4)]
    return F.concat_ws(".", *parts).alias("ip"), _number(data, at + 4, 2).alias("port")


def compact_peers(data: C) -> Column:
    """Array of (ip, port) from six-byte records; a rest that is no whole record is dropped."""

    def read(data):
        n = F.floor(F.octet_length(data) / 6).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, lambda i: F.struct(*_address(data, i * 6 + 1)))

    return _once(_c(data), read)


def compact_nodes(data: C) -> Column:
    """Array of (id hex, ip, port) from 26-byte records."""

    def read(data):
        n = F.floor(F.octet_length(data) / 26).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, lambda i: F.struct(F.lower(F.hex(F.substring(data, i * 26 + 1, F.lit(20)))).alias("id"), *_address(data, i * 26 + 21)))

    return _once(_c(data), read)


def encode_peer(ip: C, port: C) -> Column:
    """Six bytes of an address."""

    def write(a):
        octets = [F.lpad(F.hex(F.get(a["octets"], i).cast("int")), 2, "0") for i in range(4)]
        return F.unhex(F.concat(*octets, F.lpad(F.hex(a["port"]), 4, "0")))

    return _once(F.struct(F.split(_c(ip), r"\.").alias("octets"), _c(port).cast("int").alias("port")), write)


def listed_peers(peers: C) -> Column:
    """(ip, port) of an array of such structs, without those lacking an address or a port in range."""
    return F.filter(_c(peers), lambda p: (F.coalesce(p["ip"], F.lit("")) != "") & F.coalesce(p["port"].between(1, 65535), F.lit(False)))


# -- magnet links --------------------------------------------------------------


def magnet_parts(link: C) -> Column:
    """Struct of the link's parameters; null without the scheme or a hex or base32 topic (see codecs.base32_hex)."""
    pairs = F.split(F.regexp_extract(_c(link), r"^magnet:\?(.*)$", 1), "&")
    values = lambda name: F.transform(F.filter(pairs, lambda p: F.startswith(F.lower(p), F.lit(name + "="))), lambda p: F.url_decode(F.substring(p, F.lit(len(name) + 2), F.length(p))))
    topic = F.regexp_extract(F.get(F.filter(values("xt"), lambda x: F.startswith(F.lower(x), F.lit("urn:btih:"))), 0), r"^[uU][rR][nN]:[bB][tT][iI][hH]:([0-9a-fA-F]{40}|[A-Za-z2-7]{32})$", 1)
    out = F.struct(F.lower(topic).alias("topic"), F.get(values("dn"), 0).alias("name"), values("tr").alias("trackers"), values("x.pe").alias("peers"), values("ws").alias("web_seeds"))
    return F.when(F.startswith(F.lower(_c(link)), F.lit("magnet:?")) & (topic != ""), out)


def _quoted(x: Column) -> Column:
    """Percent-encoding as URIs have it: a blank is %20."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def magnet_link(info_hash: C, name: C, trackers: C) -> Column:
    """A link from hash, optional name and array of trackers."""
    head = F.concat(F.lit("magnet:?xt=urn:btih:"), F.lower(_c(info_hash)))
    label = F.when(F.coalesce(_c(name), F.lit("")) != "", F.concat(F.lit("&dn="), _quoted(_c(name)))).otherwise("")
    listed = F.array_join(F.transform(F.coalesce(_c(trackers), F.array().cast("array<string>")), lambda t: F.concat(F.lit("&tr="), _quoted(t))), "")
    return F.concat(head, label, listed)


def metadata_progress(received: C, size: C) -> Column:
    """Received parts over all parts of 16 KiB, 0 while the size is unknown."""
    return ratio(_c(received), F.ceil(zero(size) / BLOCK))
