"""MPEG audio frames: parsing with resynchronisation, and a writer whose frames carry a payload.

The parser reads ID3v2 and ID3v1 tags, finds frames by their headers, takes up again after junk, reads
Xing/Info and VBRI tables, verifies the 16-bit checksums of Layer I and III frames, and gives exact
sample counts and the byte offset of each frame.

The writer makes silent Layer III frames (no bits of main data) whose ancillary bytes hold the payload,
after an ID3v2 tag and a Xing frame.  A decoder plays silence; nothing of the payload is lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate
from functools import lru_cache

#: Fixed values of the format: kbit/s by index 1..14, for (version 1, layer) and for versions 2 and 2.5.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}

#: Bytes of payload in a unit, and the bit rate whose frame holds 1, 2, 3 or 4 units at 48 kHz.
UNIT, UNIT_KBPS = 192, {1: 80, 2: 160, 3: 224, 4: 320}
_SIDE = 17  # bytes of side information of a mono Layer III frame


@dataclass
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int  # 0: free format
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def length(self) -> int:
        """Bytes of the frame; 0 for free format."""
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4 if self.kbps else 0
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding if self.kbps else 0

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        if self.version == 1:
            return 17 if self.mode == 3 else 32
        return 9 if self.mode == 3 else 17

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes, or None where they aren't one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][index - 1] if index else 0
    return Header(version, layer, not four[1] & 1, kbps, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6, four[3] >> 4 & 3)


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum that frames carry: polynomial 0x8005, start 0xFFFF."""
    value, table = 0xFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ table[value >> 8 ^ byte]
    return value


def checksum(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None for Layer II, whose covered bits depend on its allocation tables."""
    if h.layer == 3:
        covered = h.side
    elif h.layer == 1:
        bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
        covered = 16 if h.mode == 3 else (2 * bound + 32 - bound) // 2
    else:
        return None
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered]) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Audio:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0  # of the audio frames, less the encoder's delay and padding where a table names them
    rate: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    resyncs: int = 0
    skipped: int = 0
    checked: int = 0
    failed: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int | None:
        """Byte offset of the frame that holds a sample; None outside the audio."""
        if not self.offsets or sample < 0:
            return None
        frame = sample // self.headers[0].samples
        return self.offsets[frame] if frame < len(self.offsets) else None


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(data: bytes) -> str:
    """A text frame's string; the first byte names its encoding."""
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return data[1:].decode(kinds.get(data[0], "latin-1"), "replace").rstrip("\0") if data else ""


def id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a tag at the start of ``data`` into ``tags``; gives the offset behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, size = data[3], _syncsafe(data[6:10])
    end, at = min(len(data), 10 + size), 10
    if data[5] & 0x40 and major > 2 and end - at >= 4:
        at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    head, key = (6, 3) if major == 2 else (10, 4)
    while at + head <= end and data[at : at + key].isalnum():
        name = data[at : at + key].decode()
        raw = data[at + key : at + key + (3 if major == 2 else 4)]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + head : min(end, at + head + n)]
        if name.startswith("T"):
            tags.setdefault(name, _text(body))
        at += head + n
    return end + 10 * bool(major == 4 and data[5] & 0x10)


def id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads a tag in the last 128 bytes; gives where the audio ends."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        if value := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags.setdefault(name, value)
    return len(data) - 128


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    for place in (at + 4 + h.side, at + 6 + h.side):
        if (kind := data[place : place + 4]) in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8, {"kind": kind.decode()}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw = data[p : p + size]
                    out[name] = list(raw) if name == "toc" else int.from_bytes(raw, "big")
                    p += size
            if data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
                three = int.from_bytes(data[p + 21 : p + 24], "big")
                out |= {"delay": three >> 12, "padding": three & 0xFFF}
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        p = at + 36
        number = lambda a, b: int.from_bytes(data[p + a : p + b], "big")
        count, scale, width = number(18, 20), number(20, 22), number(22, 24)
        steps = [number(26 + i * width, 26 + (i + 1) * width) * scale for i in range(count)] if at + 62 + count * width <= len(data) else []
        # The table has the bytes of each stretch of frames; places are their sums.
        return {"kind": "VBRI", "bytes": number(10, 14), "frames": number(14, 18), "frames_per_entry": number(24, 26), "toc": list(accumulate(steps[:-1], initial=0)) if steps else []}
    return None


#: Bytes that a free-format frame has at most: 640 kbit/s at 8 kHz take 11,520 with the largest slots.
FREE_MOST = 16_384


def _free(data: bytes, at: int, end: int, h: Header) -> int:
    """Length of a free-format frame: up to the next header of the same kind, or to the data's end; 0 if neither is near enough."""
    p, stop = at + 24, min(end, at + FREE_MOST + 4)
    while (p := data.find(b"\xff", p, stop)) >= 0:
        if (n := header(data[p : p + 4])) and n.like(h) and not n.kbps:
            return p - at
        p += 1
    return end - at if end - at <= FREE_MOST else 0


def parse(data: bytes) -> Audio:
    """Everything about a stream. Bytes without any frame give an Audio without offsets.

    A header counts if the next frame's header stands where it should and is of the same kind, or if the
    frame ends the data.  Where it doesn't, the search goes on with the next sync byte.
    """
    out = Audio()
    at = id3v2(data, out.tags)
    end = id3v1(data, out.tags)
    lost, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        length = (h.length or _free(data, at, end, h)) if h else 0
        good = h is not None and length >= 4 + 2 * h.protected and at + length <= end
        if good and (lost or not out.offsets) and at + length + 4 <= end:
            n = header(data[at + length : at + length + 4])
            good = n is not None and n.like(h)
        if good and out.headers and not h.like(out.headers[0]):
            good = False
        if not good:
            out.resyncs += not lost
            nxt = data.find(b"\xff", at + 1, end)
            out.skipped += (end if nxt < 0 else nxt) - at
            lost = True
            if nxt < 0:
                at = end
                break
            at = nxt
            continue
        lost = False
        if first and h.layer == 3 and (found := _table(data, at, h)):
            out.vbr, out.rate = found, h.rate
        else:
            if h.protected and (fine := checksum(data, at, h)) is not None:
                out.checked += 1
                out.failed += not fine
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
            out.rate = out.rate or h.rate
        first = False
        at += length
    out.skipped += max(0, end - at)
    if out.vbr and "delay" in out.vbr:
        out.samples = max(0, out.samples - out.vbr["delay"] - out.vbr["padding"])
    return out


@lru_cache(8)
def _frame(units: int) -> tuple[bytes, bytes]:
    """What stands before and after the payload of a frame with so many units."""
    kbps = UNIT_KBPS[units]
    head = bytes([0xFF, 0xFA, (BITRATES[1, 3].index(kbps) + 1) << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE)
    before = head + crc16(head[2:] + side).to_bytes(2, "big") + side
    return before, bytes(header(head).length - len(before) - units * UNIT)


def _id3(frames: dict[str, str]) -> bytes:
    body = b"".join(k.encode() + (len(v) + 1).to_bytes(4, "big") + b"\0\0\0" + v.encode("latin-1") for k, v in frames.items())
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def write(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A stream that carries ``payload``, a positive multiple of 192 bytes; ``n_bytes`` of it count, as the tag says."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    units = len(payload) // UNIT
    sizes = [4] * (units // 4) + ([units % 4] if units % 4 else [])
    frames, at = [], 0
    for size in sizes:
        before, after = _frame(size)
        frames += (before, payload[at : at + size * UNIT], after)
        at += size * UNIT
    audio = b"".join(frames)
    lengths = [3 * UNIT_KBPS[s] for s in sizes]
    info = 3 * UNIT_KBPS[1]
    total = info + len(audio)
    big, n = lengths[0], len(sizes)
    toc = bytes(min(255, (info + big * (k * n // 100)) * 256 // total) for k in range(100))
    head = bytes([0xFF, 0xFB, (BITRATES[1, 3].index(UNIT_KBPS[1]) + 1) << 4 | 1 << 2, 0xC0])
    xing = head + bytes(_SIDE) + b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    tag = _id3({"TLEN": str(n * 1152 * 1000 // 48000), "TSIZ": str(len(payload) if n_bytes is None else n_bytes)})
    return tag + xing + bytes(info - len(xing)) + audio


def payload(data: bytes, offsets: list[int]) -> bytes:
    """The payload of the frames that ``write`` made at ``offsets``. A frame that isn't there or whose checksum fails is an error."""
    units, out = {v: k for k, v in UNIT_KBPS.items()}, []
    for o in offsets:
        h = header(data[o : o + 4])
        if h is None or h.kbps not in units or not checksum(data, o, h):
            raise ValueError(f"no intact frame at byte {o}")
        out.append(data[o + 6 + _SIDE : o + 6 + _SIDE + UNIT * units[h.kbps]])
    return b"".join(out)
