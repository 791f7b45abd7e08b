"""Media columns: MPEG audio streams, parsed frame by frame.

``parse`` reads any MPEG-1, -2 or -2.5 audio stream of layers I to III from
its bytes: it steps over ID3v2 tags, resynchronises on frame headers (a header
counts if the next one, or the stream's end, stands where its length says),
reads Xing, Info and VBRI tables with their seek points and encoder delays,
verifies the checksums of all layers, and gives the exact number of samples and the offset of each frame,
so that a reader can seek without decoding. ``store`` writes bytes as such a
stream: layer III frames of silence whose ancillary data are the bytes, of
variable bitrate, with checksums, an ID3v2 tag and a Xing table.

Defined cases: null and empty payloads are stored as 64 zero bytes; a stream
without a single frame has none, duration 0 and all its bytes skipped; null
media parse to null; a damaged header is skipped up to the next pair of frames;
equal texts, repeated rows among them, give equal streams; an empty table gives
an empty result; a column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the MPEG audio standards: kbit/s by header index 1 to 14, and Hz by header index.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {3: 1, 2: 2, 0: 2.5}
UNIT = 64


@lru_cache(maxsize=4096)
def header(word: int) -> tuple | None:
    """(version, layer, protected, bitrate, rate, mode, length, samples) of a 32-bit frame header; None if it is none."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = VERSIONS.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    index, rate_index = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    bitrate, rate, padding = BITRATES[min(2, int(version)), layer][index - 1], RATES[version][rate_index], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12000 * bitrate // rate + padding) * 4 if layer == 1 else samples * 125 * bitrate // rate + padding
    return version, layer, not word >> 16 & 1, bitrate, rate, word >> 6 & 3, length, samples


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The standard's checksum: polynomial 0x8005, from 0xFFFF on."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first bits of some bytes."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        crc ^= (data[k // 8] >> (7 - k % 8) & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def side_info(version: float, mode: int) -> int:
    """Bytes of layer III side information."""
    return (17 if mode == 3 else 32) if version == 1 else (9 if mode == 3 else 17)


# Fixed values of the standards: bits of a layer II allocation by subband, as (subbands, bits) from the lowest on.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "half": ((4, 4), (7, 3), (19, 2)),
}


def allocation_of(version: float, bitrate: int, rate: int, channels: int) -> list[int]:
    """Bits of each subband's allocation in layer II."""
    each = bitrate // channels
    if version != 1:
        name = "half"
    elif each <= 48:
        name = "d" if rate == 32000 else "c"
    else:
        name = "a" if rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATIONS[name] for _ in range(n)]


def checked_bits(frame: bytes, h: tuple, extension: int) -> int:
    """How many bits behind the checksum it protects: side information, or allocations and what they select."""
    version, layer, _, bitrate, rate, mode, *_ = h
    if layer == 3:
        return 8 * side_info(version, mode)
    channels = 1 if mode == 3 else 2
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (32 if channels == 1 else min(bound, 32) + 32)
    word, total, at, used = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0, 0
    for subband, bits in enumerate(allocation_of(version, bitrate, rate, channels)):
        own = channels if subband < bound else 1
        for _ in range(own):
            at += bits
            if at <= total and word >> (total - at) & ((1 << bits) - 1):
                used += channels // own
    return at + 2 * used  # two bits for each subband and channel in use


def checksum_ok(frame: bytes, h: tuple) -> bool:
    bits = checked_bits(frame, h, frame[3] >> 4 & 3)
    if 48 + bits > 8 * len(frame):
        return False
    return crc16_bits(frame[2:4] + frame[6:], 16 + bits) == int.from_bytes(frame[4:6], "big")


def synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes, text frames) of the tag at the start; (0, {}) if there is none."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    size, major, at, tags = 10 + synchsafe(data[6:10]) + (10 if data[5] & 16 else 0), data[3], 10, {}
    while major >= 3 and at + 10 <= min(size, len(data)) and data[at]:
        name = data[at : at + 4].decode("latin-1")
        n = synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[f"TXXX:{key}" if name == "TXXX" else key] = value
        at += 10 + n
    return min(size, len(data)), tags


def tail_tags(data: bytes) -> tuple[int, dict[str, str]]:
    """(end of the audio, tags) before an ID3v1 and an APE tag at the end."""
    end, tags = len(data), {}
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        fields = (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4))
        tags = {f"id3v1:{k}": v for k, a, n in fields if (v := data[end - 128 + a : end - 128 + a + n].rstrip(b"\0 ").decode("latin-1"))}
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(0, end - size - (32 if flags >> 31 else 0))
    return end, tags


def table_of(frame: bytes, at: int) -> dict | None:
    """The Xing, Info or VBRI table in a stream's first frame; ``at``: where a Xing table would stand."""
    if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[key] = frame[at : at + n] if n == 100 else int.from_bytes(frame[at : at + n], "big")
                at += n
        if len(frame) >= at + 24 and frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc"):
            gap = int.from_bytes(frame[at + 21 : at + 24], "big")
            out["delay"], out["padding"] = gap >> 12, gap & 0xFFF
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, size, frames, entries, scale, width, each = struct.unpack(">HHIIHHHH", frame[42:62])
        raw = frame[62 : 62 + entries * width]
        steps = [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw) - width + 1, width)] if 0 < width <= 8 else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "delay": 0, "steps": steps, "each": each}
    return None


def seek_points(table: dict, start: int) -> list[int]:
    """Places that a table gives: of each hundredth of the playing time, or of each of its steps."""
    if "toc" in table and "bytes" in table:
        return [start + b * table["bytes"] // 256 for b in table["toc"]]
    return [start + int(n) for n in np.cumsum([0, *table["steps"]])] if table.get("steps") else []


def parse(data: bytes | None) -> dict | None:
    """What a stream holds: see the fields of ``PARSED``."""
    if data is None:
        return None
    end, more = tail_tags(data)
    found = _parse(data, end, more)
    if end < len(data):  # the bytes of a tag may be those of a frame: the end that leaves fewer bytes outside frames counts
        without_ape = len(data) - 128 if data[len(data) - 128 : len(data) - 125] == b"TAG" else end
        ends = [(without_ape, more)] * (end < without_ape) + [(len(data), {})]
        found = min([found, *[_parse(data, e, t) for e, t in ends]], key=lambda f: (not f["frames"], f["skipped"], -f["frames"]))
    return found


def _parse(data: bytes, end: int, more: dict[str, str]) -> dict:
    """What a stream holds whose audio ends at ``end``, before tags ``more``."""
    start, tags = id3v2(data)
    at, skipped, offsets, samples, first, table = start, 0, [], 0, None, None
    good = bad = unchecked = 0
    rates, table_at = set(), -1
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h and first and (h[0], h[1], h[4]) != (first[0], first[1], first[4]):
            h = None
        if h and (following := at + h[6]) != end:
            after = header(int.from_bytes(data[following : following + 4], "big")) if following + 4 <= end else None
            if not after or (after[0], after[1], after[4]) != (h[0], h[1], h[4]):
                h = None
        if not h:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            skipped, at = skipped + step - at, step
            continue
        version, layer, protected, bitrate, rate, mode, length, n = h
        if first is None:
            first = h
            if layer == 3 and (table := table_of(data[at : at + length], 4 + side_info(version, mode))):
                table_at, at = at, at + length
                continue
        if protected:
            good_one = checksum_ok(data[at : at + length], h)
            good, bad = good + good_one, bad + (not good_one)
        else:
            unchecked += 1
        offsets.append(at)
        rates.add(bitrate)
        samples, at = samples + n, at + length
    skipped += max(0, end - at)
    table = table or {}
    exact = max(0, samples - table.get("delay", 0) - table.get("padding", 0))
    version, layer, _, _, rate, mode, _, _ = first or (0, 0, 0, 0, 0, 0, 0, 0)
    toc_ok = "frames" not in table or table["frames"] == len(offsets)
    if toc_ok and "toc" in table and offsets:
        toc_ok = table["toc"] == toc_of(offsets, table_at, at)
    if toc_ok and table.get("steps") and offsets:  # a step is rounded, and may be counted from the table's frame or from the next
        whole = [*offsets, at]
        places = [whole[min(k * table["each"], len(offsets))] for k in range(len(table["steps"]) + 1)]
        toc_ok = any(all(abs(p - s) <= 2 * max(1, at // 65536) for p, s in zip(places, seek_points(table, base), strict=True)) for base in (offsets[0], table_at))
    return {
        "version": float(version), "layer": int(layer), "sample_rate": int(rate), "channels": 0 if not first else 1 if mode == 3 else 2, "frames": len(offsets), "samples": exact,
        "duration_us": exact * 1_000_000 // rate if rate else 0, "variable": len(rates) > 1, "table": table.get("kind"), "table_ok": bool(toc_ok),
        "crc_good": good, "crc_bad": bad, "crc_none": unchecked, "skipped": skipped, "tags": list((tags | more).items()), "offsets": offsets, "seek": seek_points(table, max(0, table_at)), "audio_end": at if first else start,
    }


PARSED = "version double, layer int, sample_rate int, channels int, frames long, samples long, duration_us long, variable boolean, table string, table_ok boolean, crc_good long, crc_bad long, crc_none long, skipped long, tags map<string,string>, offsets array<long>, seek array<long>, audio_end long"
_PARSED = pa.struct([
    ("version", pa.float64()), ("layer", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("samples", pa.int64()), ("duration_us", pa.int64()), ("variable", pa.bool_()), ("table", pa.string()), ("table_ok", pa.bool_()),
    ("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("crc_none", pa.int64()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("offsets", pa.list_(pa.int64())), ("seek", pa.list_(pa.int64())), ("audio_end", pa.int64()),
])


def toc_of(offsets: list[int], start: int, end: int) -> bytes:
    """A Xing table of contents: for each hundredth of the frames its place, in 256ths of the bytes."""
    n, size = len(offsets), max(1, end - start)
    return bytes(min(255, (offsets[k * n // 100] - start) * 256 // size) for k in range(100))


# Frames written: MPEG-1 layer III, protected, 32 kHz, one channel. At 32 kHz no frame needs padding.
WRITTEN = [(i, header(0xFFFA << 16 | i << 12 | 2 << 10 | 3 << 6)[6]) for i in range(1, 15)]
SIDE = 17
ROOM = WRITTEN[-1][1] - 6 - SIDE


@lru_cache(maxsize=16)
def opening(index: int) -> bytes:
    """Header, checksum and empty side information of a frame of silence."""
    head = (0xFFFA << 16 | index << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


common.held("audio", crc16.cache_clear)


def text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + body


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def store(payload: bytes | None) -> bytes:
    """A stream that carries the padded payload; its length stands in the tag."""
    raw = payload or b""
    data = padded(raw)
    parts, offsets, at = [], [], 0
    for a in range(0, len(data), ROOM):
        piece = data[a : a + ROOM]
        index, length = next((i, n) for i, n in WRITTEN if n >= len(piece) + 6 + SIDE)
        parts += [opening(index), piece, bytes(length - 6 - SIDE - len(piece))]
        offsets.append(at)
        at += length
    lead = WRITTEN[0][1]  # the frame with the table, not protected as is usual
    tags = text_frame(b"TXXX", f"bytes\0{len(raw)}") + text_frame(b"TXXX", f"payload\0{len(data)}") + text_frame(b"TLEN", str(len(offsets) * 1152 * 1000 // 32000))
    tag = b"ID3\x04\0\0" + bytes(len(tags) >> s & 127 for s in (21, 14, 7, 0)) + tags
    head = (0xFFFB << 16 | 1 << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    table = b"Xing" + struct.pack(">III", 15, len(offsets), lead + at) + toc_of([lead + o for o in offsets], 0, lead + at) + struct.pack(">I", 0)
    return b"".join([tag, head, bytes(SIDE), table, bytes(lead - 4 - SIDE - len(table)), *parts])


def payload_of(data: bytes, parsed: dict) -> tuple[int, bytes]:
    """(bytes without padding, payload) of a stream that ``store`` wrote."""
    tags = dict(parsed["tags"])
    ends = [*parsed["offsets"][1:], parsed["audio_end"]]
    out = b"".join([data[a + 6 + SIDE : b] for a, b in zip(parsed["offsets"], ends, strict=True)])
    return int(tags["TXXX:bytes"]), out[: int(tags["TXXX:payload"])]


def probe(media: DataFrame, column: str = "media", into: str = "audio") -> DataFrame:
    """Rows with a struct of what their stream holds, exact duration and frame offsets included."""
    return media.withColumn(into, common.arrow_udf("audio", lambda_parse, PARSED)(F.col(f"`{column}`")))


def lambda_parse(media: pa.Array) -> pa.Array:
    return pa.array([parse(m) for m in media.to_pylist()], _PARSED)


def lambda_store(payload: pa.Array) -> pa.Array:
    return pa.array([store(p) for p in payload.cast(pa.binary()).to_pylist()], pa.binary())


def with_media(rows: DataFrame, column: str = "text", into: str = "media") -> DataFrame:
    """Rows with their text or bytes stored as a stream."""
    return rows.withColumn(into, common.arrow_udf("audio", lambda_store, "binary")(F.col(f"`{column}`").cast("binary")))


def _digest(media: pa.Array, audio: pa.Array) -> pa.Array:
    rows = []
    for data, a in zip(media.to_pylist(), audio.to_pylist(), strict=True):
        n, payload = payload_of(data, a)
        seek = zlib.crc32(np.array(a["offsets"], "<i8").tobytes())
        feature = f"mpeg{a['version']:g} layer{a['layer']} {a['sample_rate']}Hz ch{a['channels']} frames={a['frames']} samples={a['samples']} us={a['duration_us']} vbr={int(a['variable'])} table={a['table']}:{int(a['table_ok'])} crc={a['crc_good']}/{a['crc_bad']} skipped={a['skipped']} seek={seek:08x}"
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, a["duration_us"], a["frames"]))
    return pa.array(rows, _DIGEST)


_DIGEST = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_us", pa.int64()), ("frames", pa.int64())])
DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frames long"


def op6_mpeg_audio(documents: DataFrame) -> DataFrame:
    """The contract's row for each document, from the streams read back."""
    scratch = common.Scratch(documents.sparkSession, "media")
    media = scratch.save(with_media(documents.select("doc_id", "text")).select("doc_id", "media"), "media")
    digest = probe(media).withColumn("d", common.arrow_udf("audio", _digest, DIGEST)("media", "audio"))
    return digest.select("doc_id", "d.*")
