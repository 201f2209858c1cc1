"""A small PBF encoder, for tests only."""

import zlib


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def zig(n):
    return (n << 1) ^ (n >> 63)


def num(field, n):
    return varint(field << 3) + varint(n)


def blob(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def packed(field, numbers, signed=False):
    return blob(field, b"".join(varint(zig(n) if signed else n) for n in numbers)) if numbers else b""


def deltas(numbers):
    return [b - a for a, b in zip([0, *numbers], numbers)]


def header(bbox=None, program="w"):
    box = b"".join(num(k + 1, zig(v)) for k, v in enumerate(bbox)) if bbox else None
    return (blob(1, box) if box is not None else b"") + blob(4, b"OsmSchema-V0.6") + blob(16, program.encode())


class Strings:
    def __init__(self):
        self.all = [""]

    def __call__(self, s):
        if s not in self.all:
            self.all.append(s)
        return self.all.index(s)


def block(nodes=(), ways=(), relations=(), single=(), granularity=None, lat_offset=None, lon_offset=None, groups=1):
    """nodes: (id, lat units, lon units); ways: (id, [(k, v)], refs); relations: (id, [(k, v)], [(type, ref)])."""
    s, out = Strings(), b""
    tags = lambda t: packed(2, [s(k) for k, _ in t]) + packed(3, [s(v) for _, v in t])
    step = -(-max(len(nodes), 1) // groups)
    for k in range(groups):
        group, part = b"", nodes[k * step : (k + 1) * step]
        if part:
            dense = b"".join(packed(f, deltas([n[j] for n in part]), True) for f, j in ((1, 0), (8, 1), (9, 2)))
            group += blob(2, dense)
        if k == 0:
            group += b"".join(blob(1, num(1, zig(i)) + num(8, zig(a)) + num(9, zig(o))) for i, a, o in single)
            group += b"".join(blob(3, num(1, i) + tags(t) + packed(8, deltas(r), True)) for i, t, r in ways)
            group += b"".join(blob(4, num(1, i) + tags(t) + packed(9, deltas([r for _, r in m]), True) + packed(10, [kind for kind, _ in m])) for i, t, m in relations)
        out += blob(2, group)
    extra = b"".join(num(f, v) for f, v in ((17, granularity), (19, lat_offset), (20, lon_offset)) if v is not None)
    return blob(1, b"".join(blob(1, x.encode()) for x in s.all)) + out + extra


def frame(kind, payload, raw=False, sized=True):
    body = (blob(1, payload) if raw else b"") + (num(2, len(payload)) if sized else b"") + (b"" if raw else blob(3, zlib.compress(payload)))
    head = blob(1, kind.encode()) + num(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def write(path, *frames):
    path.write_bytes(b"".join(frames))
    return str(path)
