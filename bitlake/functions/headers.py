"""Parameter sets, slice headers and side messages of one unit's payload, as dictionaries of their fields.

These are the row helpers of operators/parameters.py, which reads them in Arrow batches and does the rest (binding of
sets to slices, dimensions, rates) on DataFrames. A payload that breaks the syntax raises ValueError with the reason.
"""

from __future__ import annotations

# Profiles whose sequence sets have the chroma, depth and scaling fields.
HIGH = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)
#: Zero bits that may be read beyond a payload's end.
SLACK = 1024
SLICES = ("P", "B", "I", "SP", "SI")


class Bits:
    """A payload read bit by bit, the most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u(self, n: int) -> int:
        lo, stop = self.at >> 3, self.at + n
        if stop > 8 * len(self.data) + SLACK:
            raise ValueError("end of bitstream")
        hi = (stop + 7) >> 3
        self.at = stop
        return (int.from_bytes(self.data[lo:hi].ljust(hi - lo, b"\0"), "big") >> (8 * hi - stop)) & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.u(1) == 1

    def ue(self) -> int:
        """Leading zeros, a one and as many bits again: all within the next 63 bits, which are taken at once."""
        lo = self.at >> 3
        ahead = (int.from_bytes(self.data[lo : lo + 9].ljust(9, b"\0"), "big") >> (8 - (self.at & 7))) & ((1 << 64) - 1)
        zeros = 64 - ahead.bit_length()
        if zeros > 31:
            self.u(32)
            raise ValueError("exp-golomb overflow")
        self.u(2 * zeros + 1)
        return (ahead >> (63 - 2 * zeros)) - 1

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def te(self, most: int) -> int:
        return self.ue() if most > 1 else 1 - self.u(1)

    def more(self) -> bool:
        """Whether a bit of data is left before the stop bit, the last one that is set."""
        body = self.data.rstrip(b"\0")
        if not body:
            return False
        return self.at < 8 * len(body) - 1 - ((body[-1] & -body[-1]).bit_length() - 1)


def scaling_list(b: Bits, size: int) -> list[int]:
    """Differences modulo 256; a scale of 0 repeats the last one to the list's end."""
    out, last, live = [], 8, True
    for _ in range(size):
        if live:
            scale = (last + b.se()) % 256
            live = scale != 0
            last = scale or last
        out.append(last)
    return out


def scaling_lists(b: Bits, n: int) -> list[list[int] | None]:
    """n lists, six of 16 and then of 64 scales; None where the stream has none."""
    return [scaling_list(b, 16 if i < 6 else 64) if b.flag() else None for i in range(n)]


def _rates(b: Bits) -> None:
    """Reads over the rate and buffer fields."""
    n = b.ue()
    if n > 31:
        raise ValueError("invalid HRD CPB count")
    b.u(8)
    for _ in range(n + 1):
        b.ue(), b.ue(), b.u(1)
    b.u(20)


def _usability(b: Bits) -> dict:
    s: dict = {}
    if b.flag() and b.u(8) == 255:
        b.u(32)
    if b.flag():
        b.u(1)
    if b.flag():
        b.u(3)
        s["full_range"] = b.flag()
        if b.flag():
            s["primaries"], s["transfer"], s["matrix"] = b.u(8), b.u(8), b.u(8)
    if b.flag():
        s["chroma_location"] = b.ue()
        b.ue()
    if b.flag():
        s["num_units_in_tick"], s["time_scale"], s["fixed_rate"] = b.u(32), b.u(32), b.flag()
    rated = [b.flag() and (_rates(b) or True) for _ in range(2)]
    if any(rated):
        b.u(1)
    b.u(1)
    if b.flag():
        b.u(1)
        restrictions = [b.ue() for _ in range(6)]
        s["max_reorder"] = restrictions[4]
    return s


def sequence_set(data: bytes) -> dict:
    """The fields of a sequence parameter set; scaling holds its lists, null where it has none."""
    b = Bits(data)
    s = {"profile": b.u(8), "constraints": b.u(6)}
    b.u(2)
    s |= {"level": b.u(8), "sps_id": b.ue(), "chroma_format": 1, "separate_planes": False, "depth_luma": 8, "depth_chroma": 8, "bypass": False, "scaling": None}
    if s["profile"] in HIGH:
        s["chroma_format"] = b.ue()
        s["separate_planes"] = s["chroma_format"] == 3 and b.flag()
        s["depth_luma"], s["depth_chroma"], s["bypass"] = b.ue() + 8, b.ue() + 8, b.flag()
        if b.flag():
            s["scaling"] = scaling_lists(b, 12 if s["chroma_format"] == 3 else 8)[:8]
    s["frame_num_bits"], s["poc_type"] = b.ue() + 4, b.ue()
    s |= {"poc_lsb_bits": 4, "poc_no_deltas": False, "offset_not_ref": 0, "offset_bottom": 0, "offsets": []}
    if s["poc_type"] == 0:
        s["poc_lsb_bits"] = b.ue() + 4
    elif s["poc_type"] == 1:
        s["poc_no_deltas"], s["offset_not_ref"], s["offset_bottom"] = b.flag(), b.se(), b.se()
        s["offsets"] = [b.se() for _ in range(b.ue())]
    s |= {"max_refs": b.ue(), "gaps": b.flag(), "width_mbs": b.ue() + 1, "height_units": b.ue() + 1, "frames_only": b.flag()}
    s["mbaff"] = not s["frames_only"] and b.flag()
    s["direct_8x8"], s["cropped"] = b.flag(), b.flag()
    s |= dict(zip(("crop_left", "crop_right", "crop_top", "crop_bottom"), [b.ue() if s["cropped"] else 0 for _ in range(4)], strict=True))
    s |= {"usability": b.flag(), "full_range": False, "primaries": 2, "transfer": 2, "matrix": 2, "chroma_location": 0, "num_units_in_tick": None, "time_scale": None, "fixed_rate": False, "max_reorder": None}
    return s | (_usability(b) if s["usability"] else {})


def picture_set(data: bytes) -> dict:
    """The fields of a picture parameter set; scaling as in a sequence set, transform_8x8 and the rest if present."""
    b = Bits(data)
    p = {"pps_id": b.ue(), "sps_id": b.ue(), "arithmetic": b.flag(), "bottom_deltas": b.flag()}
    if b.ue():
        raise ValueError("slice groups cannot be read")
    p |= {"refs_l0": b.ue() + 1, "refs_l1": b.ue() + 1, "weighted": b.flag(), "weighted_bi": b.u(2)}
    p |= {"init_qp": 26 + b.se(), "init_qs": 26 + b.se(), "chroma_offset": b.se(), "filter_control": b.flag(), "constrained_intra": b.flag(), "redundant": b.flag()}
    p |= {"transform_8x8": False, "scaling": None, "second_chroma_offset": p["chroma_offset"]}
    if b.more():
        p["transform_8x8"] = b.flag()
        if b.flag():
            p["scaling"] = scaling_lists(b, 8 if p["transform_8x8"] else 6)
        p["second_chroma_offset"] = b.se()
    return p


def slice_start(data: bytes) -> dict:
    """What can be read of a slice header without its parameter sets."""
    b = Bits(data)
    first, kind = b.ue(), b.ue()
    if kind > 9:
        raise ValueError("invalid slice_type")
    return {"first_mb": first, "slice_type": SLICES[kind % 5], "pps_id": b.ue()}


def _until(b: Bits, stop: int, values) -> list[tuple[int, int, int]]:
    """Operations up to number `stop`: (number, first value, second value), as many values as values(number) says."""
    out = []
    while (op := b.ue()) != stop:
        n = values(op)
        if n < 0:
            break
        read = [b.ue() for _ in range(n)]
        out.append((op, *read, *[0] * (2 - n)))
    return out


def _weights(b: Bits, n: int, luma: int, chroma: int) -> list[list[int]]:
    """(luma weight, offset, Cb weight, offset, Cr weight, offset) of each reference."""
    out = []
    for _ in range(n):
        y = [b.se(), b.se()] if b.flag() else [1 << luma, 0]
        out.append(y + ([b.se() for _ in range(4)] if b.flag() else [1 << chroma, 0, 1 << chroma, 0]))
    return out


def slice_header(data: bytes, sps: dict, pps: dict, unit_type: int, ref_idc: int) -> dict:
    """The fields of a slice header under its parameter sets; data_bit is where the macroblocks begin."""
    b, s = Bits(data), slice_start(data)
    b.ue(), b.ue(), b.ue()
    p_or_b, is_b, idr = s["slice_type"] in ("P", "SP", "B"), s["slice_type"] == "B", unit_type == 5
    s["frame_num"] = b.u(sps["frame_num_bits"])
    s["field"] = not sps["frames_only"] and b.flag()
    s["bottom"] = s["field"] and b.flag()
    s["mbaff"] = sps["mbaff"] and not s["field"]
    s["idr_pic_id"] = b.ue() if idr else None
    s |= {"poc_lsb": 0, "delta_bottom": 0, "delta_0": 0, "delta_1": 0}
    both = pps["bottom_deltas"] and not s["field"]
    if sps["poc_type"] == 0:
        s["poc_lsb"] = b.u(sps["poc_lsb_bits"])
        s["delta_bottom"] = b.se() if both else 0
    elif sps["poc_type"] == 1 and not sps["poc_no_deltas"]:
        s["delta_0"] = b.se()
        s["delta_1"] = b.se() if both else 0
    s["direct_spatial"] = is_b and b.flag()
    s["refs_l0"], s["refs_l1"] = pps["refs_l0"] if p_or_b else 0, pps["refs_l1"] if is_b else 0
    if p_or_b and b.flag():
        s["refs_l0"] = b.ue() + 1
        s["refs_l1"] = b.ue() + 1 if is_b else 0
    s["changes_l0"] = [x[:2] for x in _until(b, 3, lambda _: 1)] if p_or_b and b.flag() else []
    s["changes_l1"] = [x[:2] for x in _until(b, 3, lambda _: 1)] if is_b and b.flag() else []
    s |= {"luma_denom": None, "chroma_denom": None, "weights_l0": None, "weights_l1": None}
    if (s["slice_type"] == "P" and pps["weighted"]) or (is_b and pps["weighted_bi"] == 1):
        luma, chroma = b.ue(), b.ue()
        if max(luma, chroma) > 7:
            raise ValueError("log2_weight_denom out of range")
        s |= {"luma_denom": luma, "chroma_denom": chroma, "weights_l0": _weights(b, s["refs_l0"], luma, chroma), "weights_l1": _weights(b, s["refs_l1"], luma, chroma)}
    s["no_output"] = idr and b.flag()
    s["long_term"] = idr and b.flag()
    s["marking"] = _until(b, 0, lambda op: {1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1}.get(op, -1)) if not idr and ref_idc and b.flag() else []
    s["cabac_init"] = b.ue() if pps["arithmetic"] and p_or_b else 0
    if s["cabac_init"] > 2:
        raise ValueError("cabac_init_idc out of range")
    s["qp_delta"] = b.se()
    s |= {"filter_off": b.ue() if pps["filter_control"] else 0, "alpha_offset": 0, "beta_offset": 0}
    if pps["filter_control"] and s["filter_off"] != 1:
        s["alpha_offset"], s["beta_offset"] = b.se(), b.se()
    s["data_bit"] = b.at
    return s


# The sentences of faults in side messages and configuration records, which results are compared by.
def messages(data: bytes) -> list[tuple[int, bytes | None, bytes]]:
    """(type, uuid, data) of each supplemental message; only type 5, user data, has a uuid."""
    out, at = [], 0
    while at < len(data) and not (data[at] == 0x80 and not data[at:].strip(b"\x80\0")):
        read = []
        for what in ("type", "size"):
            n = 0
            while at < len(data) and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= len(data):
                raise ValueError(f"unexpected end of SEI payload {what}")
            read.append(n + data[at])
            at += 1
        kind, size = read
        if at + size > len(data):
            raise ValueError("SEI payload size exceeds RBSP length")
        body = data[at : at + size]
        at += size
        if kind == 5 and size < 16:
            raise ValueError("user_data_unregistered payload too short for UUID")
        out.append((kind, body[:16], body[16:]) if kind == 5 else (kind, None, body))
    return out


def configuration(data: bytes) -> dict:
    """length_size and the parameter-set units of a file's decoder configuration record."""
    if len(data) < 7:
        raise ValueError("avcC: too short")
    if data[0] != 1:
        raise ValueError("avcC: unsupported configurationVersion")
    c, at = {"length_size": (data[4] & 3) + 1}, 5
    if c["length_size"] == 3:
        raise ValueError("avcC: invalid lengthSizeMinusOne")
    for name, mask in (("SPS", 31), ("PPS", 255)):
        if at >= len(data):
            raise ValueError("avcC: missing PPS count")
        n, units = data[at] & mask, []
        at += 1
        for _ in range(n):
            if at + 2 > len(data):
                raise ValueError(f"avcC: truncated {name} length")
            size = int.from_bytes(data[at : at + 2], "big")
            at += 2 + size
            if at > len(data):
                raise ValueError(f"avcC: truncated {name} data")
            units.append(data[at - size : at])
        c[name.lower()] = [u for u in units if u and u[0] < 128]
    return c
