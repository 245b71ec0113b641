"""Tables inside JPEG segments: quantisation, Huffman, sampling."""

from __future__ import annotations

# Counts of codes by length in the standard's example tables (ITU-T T.81, annex K): DC, then AC, luminance and chrominance.
STANDARD_COUNTS = {
    (0, 0): "0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0",
    (0, 1): "0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0",
    (1, 0): "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
    (1, 1): "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
}
NOTATIONS = {(2, 2): "4:2:0", (2, 1): "4:2:2", (1, 1): "4:4:4", (4, 1): "4:1:1", (1, 2): "4:4:0"}


def quantisation(body: bytes) -> list[tuple[int, list[int]]]:
    """(id, 64 values in file order) of a DQT segment's tables of 8 or 16 bits; a table cut short ends the list."""
    out, at = [], 0
    while at < len(body):
        wide, ident = body[at] >> 4, body[at] & 15
        size = 128 if wide else 64
        raw = body[at + 1 : at + 1 + size]
        if len(raw) < size:
            break
        out.append((ident, [int.from_bytes(raw[k : k + 2], "big") for k in range(0, 128, 2)] if wide else list(raw)))
        at += 1 + size
    return out


def huffman(body: bytes) -> list[tuple[int, int, list[int], list[int], bool]]:
    """(class, id, counts, symbols, optimised) of a DHT segment's tables. The standard's counts, DC and AC, are not optimised."""
    out, at = [], 0
    while at + 17 <= len(body):
        kind, ident = body[at] >> 4, body[at] & 15
        counts = list(body[at + 1 : at + 17])
        symbols = list(body[at + 17 : at + 17 + sum(counts)])
        if len(symbols) < sum(counts):
            break
        out.append((kind, ident, counts, symbols, counts != [int(x) for x in STANDARD_COUNTS.get((kind, ident), "").split()]))
        at += 17 + sum(counts)
    return out


def sampling(body: bytes) -> str | None:
    """The notation of a frame header's sampling: the first component's factors over the second's."""
    if len(body) < 6 or body[5] == 1 or len(body) < 6 + 3 * body[5]:
        return "grayscale" if len(body) >= 6 and body[5] == 1 else None
    factors = [(body[6 + 3 * k + 1] >> 4, body[6 + 3 * k + 1] & 15) for k in range(body[5])]
    (h, v), (ch, cv) = factors[0], factors[1]
    return NOTATIONS.get((h // max(1, ch), v // max(1, cv)), f"{h}x{v}")
