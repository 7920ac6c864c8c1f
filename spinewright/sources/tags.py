"""Readers of embedded tags and stream properties, from the published formats.

Each reader takes an open binary file and gives (tags, info, cover): tags with
keys in lower case and first values only, info as bitrate, duration, codec,
sample_rate and channels, and the bytes of the first picture or None.
"""

from __future__ import annotations

import base64
import io
import struct
from typing import BinaryIO

from ..fixed import ASF_ATTRIBUTES, MP4_ATOMS

Parsed = tuple[dict, dict, bytes | None]


def info(bitrate: float = 0, duration: float = 0.0, codec: str = "", sample_rate: int = 0, channels: int = 0) -> dict:
    return {"bitrate": int(bitrate), "duration": float(duration), "codec": codec, "sample_rate": int(sample_rate), "channels": int(channels)}


def _size(f: BinaryIO) -> int:
    at = f.tell()
    n = f.seek(0, io.SEEK_END)
    f.seek(at)
    return n


# ID3

_CODECS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
# Three-letter frames of version 2.2, and what they are called later.
_SHORT = {"TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TAL": "TALB", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TCO": "TCON", "TCM": "TCOM", "TXX": "TXXX", "PIC": "APIC", "TS2": "TSO2"}


def _syncsafe(b: bytes) -> int:
    n = 0
    for x in b:
        n = n << 7 | x & 0x7F
    return n


def _texts(kind: int, raw: bytes) -> list[str]:
    text = raw.decode(_CODECS[kind if kind < 4 else 0], "replace")
    return [x.lstrip("﻿") for x in text.rstrip("\0").split("\0")]


def _picture(raw: bytes, short: bool) -> bytes:
    kind, at = raw[0], 4 if short else raw.index(b"\0", 1) + 1
    at += 1  # what it shows
    if kind in (1, 2):
        while raw[at : at + 2] != b"\0\0":
            at += 2
        return raw[at + 2 :]
    return raw[raw.index(b"\0", at) + 1 :]


def read_id3(f: BinaryIO) -> tuple[dict, bytes | None, int]:
    """Tags, picture and length of an ID3v2 tag at the start; without one, those of ID3v1 at the end."""
    f.seek(0)
    head = f.read(10)
    tags: dict[str, str] = {}
    cover = None
    if head[:3] != b"ID3":
        n = _size(f)
        if n >= 128:
            f.seek(n - 128)
            old = f.read(128)
            if old[:3] == b"TAG":
                text = lambda a, b: old[a:b].split(b"\0")[0].decode("latin-1").strip()
                tags = {k: v for k, v in {"tit2": text(3, 33), "tpe1": text(33, 63), "talb": text(63, 93), "tdrc": text(93, 97)}.items() if v}
                if old[125] == 0 and old[126]:
                    tags["trck"] = str(old[126])
        return tags, None, 0
    version, flags, size = head[3], head[5], _syncsafe(head[6:10])
    data = f.read(size)
    if flags & 0x80 and version < 4:
        data = data.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:
        n = _syncsafe(data[:4]) if version == 4 else struct.unpack(">I", data[:4])[0] + 4
        at = n
    width, head_size = (3, 6) if version == 2 else (4, 10)
    while at + head_size <= len(data) and data[at] != 0:
        name = data[at : at + width].decode("latin-1")
        if version == 2:
            n, own_flags = int.from_bytes(data[at + 3 : at + 6], "big"), 0
        else:
            n = _syncsafe(data[at + 4 : at + 8]) if version == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            own_flags = data[at + 9]
        raw = data[at + head_size : at + head_size + n]
        at += head_size + n
        if version == 4:
            if own_flags & 0x01:
                raw = raw[4:]
            if own_flags & 0x02:
                raw = raw.replace(b"\xff\x00", b"\xff")
        name = _SHORT.get(name, name) if version == 2 else name
        if not raw:
            continue
        try:
            if name == "TXXX":
                described, *values = _texts(raw[0], raw[1:])
                tags[f"txxx:{described}".lower()] = values[0] if values else ""
            elif name[0] == "T":
                tags.setdefault(name.lower(), _texts(raw[0], raw[1:])[0])
            elif name == "APIC" and cover is None:
                cover = _picture(raw, version == 2)
        except (ValueError, IndexError):
            continue
    if "tyer" in tags:  # years of older versions go by the later name
        tags.setdefault("tdrc", tags.pop("tyer"))
    return tags, cover, 10 + size


# MPEG audio

# kbit/s by version and layer, and sample rates.
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mpeg_frame(b: bytes):
    """(bytes, kbit/s, sample rate, channels, samples, version) of the frame that begins here, or None."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, sample = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sample == 3:
        return None
    one = version == 3
    kbps, hz = _RATES[(1 if one else 2, layer)][rate], _SAMPLES[version][sample]
    samples = 384 if layer == 1 else 1152 if one or layer == 2 else 576
    size = (12 * kbps * 1000 // hz + (b[2] >> 1 & 1)) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + (b[2] >> 1 & 1)
    return size, kbps, hz, 1 if b[3] >> 6 == 3 else 2, samples, one


def read_mpeg(f: BinaryIO) -> Parsed:
    tags, cover, at = read_id3(f)
    total = _size(f)
    f.seek(at)
    head = f.read(1 << 17)
    for k in range(max(0, len(head) - 4)):
        frame = _mpeg_frame(head[k : k + 4])
        if frame and (k + frame[0] + 4 > len(head) or _mpeg_frame(head[k + frame[0] : k + frame[0] + 4])):
            break
    else:
        if not tags:
            raise ValueError("no frame")
        return tags, info(), cover
    size, kbps, hz, channels, samples, one = frame
    body = head[k : k + size]
    side = (32 if channels == 2 else 17) if one else (17 if channels == 2 else 9)
    frames = length = 0
    mark = body[4 + side : 8 + side]
    if mark in (b"Xing", b"Info"):
        flags = struct.unpack(">I", body[8 + side : 12 + side])[0]
        p = 12 + side
        if flags & 1:
            frames = struct.unpack(">I", body[p : p + 4])[0]
            p += 4
        if flags & 2:
            length = struct.unpack(">I", body[p : p + 4])[0]
    elif body[36:40] == b"VBRI":
        length, frames = struct.unpack(">II", body[46:54])
    if frames:
        duration = frames * samples / hz
        return tags, info((length or total - at - k) * 8 / duration, duration, "mp3", hz, channels), cover
    return tags, info(kbps * 1000, 8 * (total - at - k) / (kbps * 1000), "mp3", hz, channels), cover


# MP4


def _atoms(b: bytes, at: int = 0, end: int | None = None):
    end = len(b) if end is None else end
    while at + 8 <= end:
        n, name = struct.unpack(">I4s", b[at : at + 8])
        head = 8
        if n == 1:
            n, head = struct.unpack(">Q", b[at + 8 : at + 16])[0], 16
        n = end - at if n == 0 else n
        if n < head:
            return
        yield name, at + head, min(end, at + n)
        at += n


def _find(b: bytes, path: tuple, at: int = 0, end: int | None = None):
    for name, a, e in _atoms(b, at, end):
        if name == path[0]:
            if len(path) == 1:
                yield a, e
            else:
                yield from _find(b, path[1:], a + (4 if name == b"meta" else 0), e)


def read_mp4(f: BinaryIO) -> Parsed:
    f.seek(0)
    total, at, moov = _size(f), 0, b""
    while at + 8 <= total:  # the top level, without what holds the sound
        f.seek(at)
        n, name = struct.unpack(">I4s", f.read(8))
        head = 8
        if n == 1:
            n, head = struct.unpack(">Q", f.read(8))[0], 16
        n = total - at if n == 0 else n
        if n < head:
            break
        if name == b"moov":
            f.seek(at + head)
            moov = f.read(n - head)
            break
        at += n
    found = info(codec="aac")
    for a, e in _find(moov, (b"trak", b"mdia")):
        if not any(moov[x + 8 : x + 12] == b"soun" for x, _ in _find(moov, (b"hdlr",), a, e)):
            continue
        for x, _ in _find(moov, (b"mdhd",), a, e):
            wide = moov[x] == 1
            scale, length = struct.unpack(">IQ", moov[x + 20 : x + 32]) if wide else struct.unpack(">II", moov[x + 12 : x + 20])
            found["duration"] = length / scale if scale else 0.0
        for x, y in _find(moov, (b"minf", b"stbl", b"stsd"), a, e):
            for name, p, q in _atoms(moov, x + 8, y):
                found["channels"] = struct.unpack(">H", moov[p + 16 : p + 18])[0]
                found["sample_rate"] = struct.unpack(">H", moov[p + 24 : p + 26])[0]
                esds = moov.find(b"esds", p, q)
                config = moov.find(b"\x04", esds + 8, q) if esds >= 0 else -1
                if config >= 0:
                    p = config + 1
                    while moov[p] & 0x80:
                        p += 1
                    found["bitrate"] = struct.unpack(">I", moov[p + 10 : p + 14])[0]
        break
    tags, cover = {}, None
    for a, e in _find(moov, (b"udta", b"meta", b"ilst")):
        for name, x, y in _atoms(moov, a, e):
            parts = {n: moov[p:q] for n, p, q in reversed(list(_atoms(moov, x, y)))}
            data = parts.get(b"data")
            if data is None:
                continue
            kind, value, key = struct.unpack(">I", data[:4])[0] & 0xFFFFFF, data[8:], name.decode("latin-1")
            if key == "----":
                tags["txxx:" + parts[b"name"][4:].decode("utf-8", "replace").split(":")[0].lower()] = value.decode("utf-8", "replace")
            elif key in ("trkn", "disk"):
                tags[key] = str(struct.unpack(">H", value[2:4])[0])
            elif key == "covr":
                cover = cover or value
            else:
                own = MP4_ATOMS.get(key) or MP4_ATOMS.get(key.lower()) or key.lower()
                tags[own] = str(int.from_bytes(value, "big", signed=True)) if kind in (0, 21) and len(value) <= 8 else value.decode("utf-8", "replace")
    return tags, found, cover


# FLAC and Ogg


def _comments(b: bytes) -> dict:
    at = 4 + struct.unpack("<I", b[:4])[0]
    n = struct.unpack("<I", b[at : at + 4])[0]
    at += 4
    tags: dict[str, str] = {}
    for _ in range(n):
        size = struct.unpack("<I", b[at : at + 4])[0]
        key, _, value = b[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        tags.setdefault(key.lower(), value)
        at += 4 + size
    return tags


def _flac_picture(b: bytes) -> bytes:
    at = 8 + struct.unpack(">I", b[4:8])[0]
    at += 4 + struct.unpack(">I", b[at : at + 4])[0] + 16
    n = struct.unpack(">I", b[at : at + 4])[0]
    return b[at + 4 : at + 4 + n]


def read_flac(f: BinaryIO) -> Parsed:
    tags, cover, found = {}, None, info(codec="flac")
    f.seek(4)
    last = False
    while not last:
        head = f.read(4)
        if len(head) < 4:
            break
        last, kind, n = head[0] >> 7, head[0] & 0x7F, int.from_bytes(head[1:], "big")
        b = f.read(n)
        if kind == 0:
            x = int.from_bytes(b[10:18], "big")
            hz, channels, samples = x >> 44, (x >> 41 & 7) + 1, x & (1 << 36) - 1
            found |= {"sample_rate": hz, "channels": channels, "duration": samples / hz if hz else 0.0}
        elif kind == 4:
            tags = _comments(b)
        elif kind == 6 and cover is None:
            cover = _flac_picture(b)
    if found["duration"]:
        found["bitrate"] = int((_size(f) - f.tell()) * 8 / found["duration"])
    return tags, found, cover


def read_ogg(f: BinaryIO) -> Parsed:
    f.seek(0)
    packets, part, serial = [], b"", None
    while len(packets) < 2:
        head = f.read(27)
        if len(head) < 27 or head[:4] != b"OggS":
            break
        sizes = f.read(head[26])
        body = f.read(sum(sizes))
        serial, at = head[14:18], 0
        for n in sizes:
            part += body[at : at + n]
            at += n
            if n < 255:
                packets.append(part)
                part = b""
    total = _size(f)
    f.seek(max(0, total - (1 << 17)))
    tail = f.read()
    granule, at = 0, tail.rfind(b"OggS")
    if at >= 0 and len(tail) >= at + 14:
        granule = struct.unpack("<q", tail[at + 6 : at + 14])[0]
    first, second = (packets + [b"", b""])[:2]
    if first[:7] == b"\x01vorbis":
        channels, hz, _, nominal, _ = struct.unpack("<BIiii", first[11:28])
        tags, found = _comments(second[7:]), info(max(0, nominal), granule / hz if hz else 0, "vorbis", hz, channels)
    elif first[:8] == b"OpusHead":
        skip = struct.unpack("<H", first[10:12])[0]
        tags, found = _comments(second[8:]), info(0, max(0, granule - skip) / 48000, "opus", 0, first[9])
    else:
        raise ValueError("unknown stream")
    cover = None
    if picture := tags.get("metadata_block_picture"):
        try:
            cover = _flac_picture(base64.b64decode(picture))
        except (ValueError, struct.error):
            cover = None
    return tags, found, cover


# ASF

_ASF = "3026b2758e66cf11a6d900aa0062ce6c"
_CONTENT, _EXTENDED, _FILE, _STREAM = "3326b2758e66cf11a6d900aa0062ce6c", "40a4d0d207e3d21197f000a0c95ea850", "a1dcab8c47a9cf118ee400c00c205365", "9107dcb7b7a9cf118ee600c00c205365"


def read_asf(f: BinaryIO) -> Parsed:
    f.seek(16)
    size = struct.unpack("<Q", f.read(8))[0]
    f.seek(30)
    b = f.read(min(size, 1 << 24) - 30)
    wide = lambda x: x.decode("utf-16-le", "replace").rstrip("\0")
    tags, found, at = {}, info(codec="wma"), 0
    put = lambda k, v: tags.setdefault(ASF_ATTRIBUTES.get(k.lower()) or k.lower(), v)
    while at + 24 <= len(b):
        kind, n = b[at : at + 16].hex(), struct.unpack("<Q", b[at + 16 : at + 24])[0]
        if n < 24:
            break
        x = b[at + 24 : at + n]
        at += n
        if kind == _CONTENT:
            p = 10
            for k, m in zip(("Title", "Author", "Copyright", "Description", "Rating"), struct.unpack("<5H", x[:10])):
                if m:
                    put(k, wide(x[p : p + m]))
                p += m
        elif kind == _EXTENDED:
            p = 2
            for _ in range(struct.unpack("<H", x[:2])[0]):
                m = struct.unpack("<H", x[p : p + 2])[0]
                name = wide(x[p + 2 : p + 2 + m])
                form, m2 = struct.unpack("<HH", x[p + 2 + m : p + 6 + m])
                raw = x[p + 6 + m : p + 6 + m + m2]
                if form != 1:
                    put(name, wide(raw) if form == 0 else str(int.from_bytes(raw, "little")))
                p += 6 + m + m2
        elif kind == _FILE:
            length, _, preroll = struct.unpack("<QQQ", x[40:64])
            found["duration"] = max(0.0, length / 1e7 - preroll / 1e3)
        elif kind == _STREAM and x[:16].hex() == "409e69f84d5bcf11a8fd00805f5c442b":
            found["channels"], found["sample_rate"], bytes_per_s = struct.unpack("<HII", x[56:66])
            found["bitrate"] = bytes_per_s * 8
    return tags, found, None


# WAV, AIFF and APE


def read_riff(f: BinaryIO) -> Parsed:
    f.seek(0)
    big = f.read(4) == b"FORM"
    f.seek(12)
    tags, found, cover, rate, length = {}, info(), None, 0, 0
    while len(head := f.read(8)) == 8:
        name, n = struct.unpack(">4sI" if big else "<4sI", head)
        at = f.tell()
        if name == b"fmt ":
            _, found["channels"], found["sample_rate"], rate = struct.unpack("<HHII", f.read(12))
        elif name == b"data":
            length = n
        elif name == b"COMM":
            channels, frames, bits = struct.unpack(">HIH", f.read(8))
            exponent, mantissa = struct.unpack(">HQ", f.read(10))
            hz = int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446))
            found |= {"channels": channels, "sample_rate": hz, "duration": frames / hz if hz else 0.0, "bitrate": channels * bits * hz}
        elif name.upper() in (b"ID3 ",):
            tags, cover, _ = read_id3(io.BytesIO(f.read(n)))
        f.seek(at + n + (n & 1))
    if rate:
        found |= {"bitrate": rate * 8, "duration": length / rate}
    return tags, found, cover


def read_ape(f: BinaryIO) -> Parsed:
    total = _size(f)
    f.seek(max(0, total - 32))
    foot = f.read(32)
    tags: dict[str, str] = {}
    if foot[:8] == b"APETAGEX":
        _, size, count = struct.unpack("<III", foot[8:20])
        f.seek(total - size)
        b, at = f.read(size - 32), 0
        for _ in range(count):
            n, flags = struct.unpack("<II", b[at : at + 8])
            end = b.index(b"\0", at + 8)
            if flags >> 1 & 3 == 0:
                tags[b[at + 8 : end].decode("latin-1").lower()] = b[end + 1 : end + 1 + n].decode("utf-8", "replace").split("\0")[0]
            at = end + 1 + n
    return tags, info(), None


def read(f: BinaryIO) -> Parsed:
    """Whatever the file turns out to be by its first bytes; empty results on any failure."""
    try:
        f.seek(0)
        head = f.read(16)
        if head[:4] == b"fLaC":
            return read_flac(f)
        if head[:4] == b"OggS":
            return read_ogg(f)
        if head[4:8] == b"ftyp":
            return read_mp4(f)
        if head.hex() == _ASF:
            return read_asf(f)
        if head[:4] == b"RIFF" or head[:4] == b"FORM":
            return read_riff(f)
        if head[:4] == b"MAC ":
            return read_ape(f)
        return read_mpeg(f)
    except (ValueError, IndexError, KeyError, struct.error, OSError, ZeroDivisionError):
        return {}, info(), None
