"""Several values packed in one field: one value per row with its position kept.

The work is done on whole Arrow string buffers, not on single texts. Per batch: byte classes by table lookup, quote
parity by running counts of the quotes that open or close an item, delimiter masks outside quotes, boundaries from
the masks, child offsets from the boundaries, pieces gathered into one child array, and a list array over it whose
flattened form carries the parent's ordinal.

Two families of delimiters are told apart. Strong ones (line breaks, bullets, tabs, bars, semicolons, spaced
slashes, pluses and dashes, numbering, list literals) split wherever they stand outside quotes. Weak ones (commas,
"and", "&", unspaced slashes) also stand inside single values, so they split only texts without a strong one, and
only where both sides stand alone as a value; what does not stand alone joins its neighbour. Running prose stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that name an office by themselves; a piece of a title stands alone if it has one (RE2 syntax).
OFFICES = (
    r"(?i)\b(officer|chair|chairman|chairwoman|chairperson|president|director|counsel|treasurer|controller|comptroller|founder|co-founder|secretary|"
    r"head|manager|partner|principal|member|advisor|adviser|executive|lead|vice chair|trustee|owner|general|c[a-z]o|c[a-z]{2}o|[es]?vp|gc)\b"
)
_PROSE = r"(?s)^\s*[^\[\"'].*\S+(?:\s+\S+){3,}.*[.!?]\s*$"
_STAND_IN = r"(?i)^\s*(?:n/?a|n\.a\.?|none|null|nil|unknown|tb[dc]|-+|\?+|\.+)?\s*$"
#: Signs that only ever part values.
GLYPHS = "•·‣›▪◦●■□►▶※、；｜，"
_MARKS = rf"^[\s;|{GLYPHS}–+/\t,*]+|[\s;|{GLYPHS}–+/\t,]+$"

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_EDGE = np.zeros(256, bool)  # bytes that may stand beside an enclosing quote
_EDGE[list(b";|,+/[]&()\t\r\n-.")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


def _shift(a: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """``a`` moved by ``by`` places, so that element i holds what stood at i + by."""
    out = np.full_like(a, fill)
    if by > 0:
        out[:-by] = a[by:]
    elif by < 0:
        out[-by:] = a[:by]
    else:
        out[:] = a
    return out


def _parity(data: np.ndarray, quote: int, before: np.ndarray, after: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """True inside quoted items: an opening quote follows an edge, a closing one precedes an edge; odd rows have none."""
    is_q = data == quote
    escaped = is_q & (_shift(data, -1) == ord("\\"))
    opens, closes = is_q & before & ~escaped, is_q & after & ~escaped
    both = opens & closes
    opens, closes = opens & ~both, closes & ~both
    if not opens.any():
        return np.zeros(len(data), bool)
    balance = np.bincount(row[opens], minlength=n) == np.bincount(row[closes], minlength=n)
    opens, closes = opens & balance[row], closes & balance[row]
    depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))
    return (depth > 0) | closes


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of the byte ranges [start, end) of ``data``."""
    lengths = np.maximum(ends - starts, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[index].tobytes()))


def _clean(pieces: pa.Array) -> pa.Array:
    """Pieces without blanks, delimiters, list marks, or quotes that only enclose them."""
    x = pc.utf8_trim_whitespace(pieces)
    x = pc.replace_substring_regex(x, r"^(?:and|&)\s+", "")
    x = pc.replace_substring_regex(x, _MARKS, "")
    double = pc.match_substring_regex(x, r'(?s)^".*"$')
    single = pc.match_substring_regex(x, r"(?s)^'.*'$")
    inner = pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(x, 1, -1))
    unescaped = pc.replace_substring(pc.replace_substring(inner, '\\"', '"'), '""', '"')
    x = pc.if_else(double, unescaped, pc.if_else(single, pc.replace_substring(pc.replace_substring(inner, "\\'", "'"), "''", "'"), x))
    return x


def split_array(texts: pa.Array, offices: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent ordinal, position from 1, item) of the values of every text that holds at least two.

    ``offices``: pieces are offices (a qualifier such as a department joins the office before it); otherwise they are
    features (a lone word joins what follows it). Null and empty texts, stand-ins, prose and single values give nothing.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offs, body = texts.buffers()
    bounds = np.frombuffer(offs, np.int64, n + 1)
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    # one line feed before and after each text, so that no look around a byte leaves its text
    lengths = np.diff(bounds)
    start = np.arange(n) * 2 + bounds[:-1] + 1
    size = int(bounds[-1]) + 2 * n
    data = np.full(size, 10, np.uint8)
    data[np.arange(int(bounds[-1])) + np.repeat(start - bounds[:-1], lengths)] = raw[: int(bounds[-1])]
    end = start + lengths
    row = np.repeat(np.arange(n), lengths + 2)
    inside = np.zeros(size, bool)
    inside[np.arange(int(bounds[-1])) + np.repeat(start - bounds[:-1], lengths)] = True

    skip = pc.or_(pc.match_substring_regex(texts, _PROSE), pc.match_substring_regex(texts, _STAND_IN)).to_numpy(zero_copy_only=False)
    literal = pc.match_substring_regex(texts, r"(?s)^\s*\[.*\]\s*$").to_numpy(zero_copy_only=False)

    space, prev, nxt = _SPACE[data], _shift(data, -1, 10), _shift(data, 1, 10)
    # last byte that is no space, before and after each byte
    at = np.arange(size)
    back = np.maximum.accumulate(np.where(space & inside, -1, at))
    ahead = np.minimum.accumulate(np.where(space & inside, size, at)[::-1])[::-1]
    left, right = data[np.clip(_shift(back, -1, 0), 0, size - 1)], data[np.clip(_shift(ahead, 1, size - 1), 0, size - 1)]
    tail = np.isin(left, [0x93, *(g.encode()[-1] for g in GLYPHS)])  # last bytes of the signs and the dash below
    head = np.isin(right, [0xE2, *(g.encode()[0] for g in GLYPHS)])
    word_before = space[np.clip(at - 1, 0, size - 1)] & np.isin(left, list(b"d"))  # "and " before a quoted item
    breaks = list(b"\t\r\n")
    before = _EDGE[left] | tail | word_before | np.isin(prev, breaks)
    after = _EDGE[right] | head | (_SPACE[nxt] & (right == ord("a"))) | np.isin(nxt, breaks)
    quoted = _parity(data, ord('"'), before, after, row, n)
    quoted |= _parity(data, ord("'"), before, after, row, n)
    free = inside & ~quoted & ~skip[row]

    spaced = space[np.clip(at - 1, 0, size - 1)] & _SPACE[nxt]
    cut_len = np.zeros(size, np.int64)  # length of the delimiter that starts at a byte

    def mark(mask: np.ndarray, length: int | np.ndarray) -> None:
        cut_len[mask & free] = length if isinstance(length, int) else length[mask & free]

    mark(np.isin(data, list(b";|\t\n\r")), 1)
    for text in GLYPHS:
        b = text.encode()
        mark(np.logical_and.reduce([_shift(data, i) == x for i, x in enumerate(b)]), len(b))
    dash = "–".encode()
    is_dash = np.logical_and.reduce([_shift(data, i) == x for i, x in enumerate(dash)])
    mark(is_dash & (space[np.clip(at - 1, 0, size - 1)] | _shift(space, len(dash), True) | (at == start[row])), len(dash))
    mark((data == ord("+")) & (spaced | (at == start[row]) | (at == end[row] - 1)), 1)
    slash = data == ord("/")
    mark(slash & (nxt == ord("/")) & (_shift(data, 2) != ord("/")), 2)
    mark(slash & spaced, 1)
    mark(slash & ((at == start[row]) | (at == end[row] - 1)) & (cut_len == 0) & (prev != ord("/")), 1)
    # bullets "- " at the start of a line, numbering "1. " and "(1) " at the start or after a blank
    feeds = np.cumsum(np.isin(data, (10, 13)))
    before_at = np.clip(at - 1, 0, size - 1)
    # only blanks between a line's start, or the text's, and this byte
    line = (left == 10) | (feeds[before_at] > feeds[np.clip(back[before_at], 0, size - 1)])
    mark((data == ord("-")) & line & (nxt == 32), 2)
    digit = _DIGIT[data]
    fresh = (at == start[row]) | space[np.clip(at - 1, 0, size - 1)]
    # numbers of any length and single letters
    stop_digit = np.minimum.accumulate(np.where(digit, size, at)[::-1])[::-1]
    label_end = np.where(digit & ~_shift(digit, -1, False), stop_digit, np.where((data >= ord("a")) & (data <= ord("z")), at + 1, -1))
    closing = data[np.clip(label_end, 0, size - 1)]
    spaced_after = data[np.clip(label_end + 1, 0, size - 1)] == 32
    numbered = fresh & (label_end > 0) & ((closing == ord(")")) | (closing == ord(".")) & digit) & spaced_after
    inner = _shift(label_end, 1, -1)
    circled = fresh & (data == ord("(")) & (inner > 0) & (data[np.clip(inner, 0, size - 1)] == ord(")")) & (data[np.clip(inner + 1, 0, size - 1)] == 32)
    for hit, length in ((numbered, label_end - at + 1), (circled, inner - at + 1)):
        # numbering is a list mark only where the text begins with it
        first = np.zeros(n, bool)
        lead = hit & (at == np.minimum(ahead[np.clip(start, 0, size - 1)], size - 1)[row]) & free
        first[row[lead]] = True
        mark(hit & first[row], length)
    mark(literal[row] & (data == ord(",")), 1)
    mark(literal[row] & ((at == np.minimum(ahead[start], size - 1)[row]) | (at == np.maximum(back[np.clip(end - 1, 0, size - 1)], 0)[row])), 1)

    strong = np.zeros(n, bool)
    # a stray delimiter at either end of a text separates nothing and leaves the choice to the weak ones
    first_word, last_word = np.minimum(ahead[start], size - 1), np.maximum(back[np.clip(end - 1, 0, size - 1)], 0)
    within = (cut_len > 0) & (at > first_word[row]) & (at + cut_len - 1 < last_word[row])
    blank = _SPACE[data] & (data != 9)
    # trailing line breaks and the like lie beyond the last word
    strong[row[within & ~(blank & ((at < first_word[row]) | (at > last_word[row])))]] = True
    strong |= literal

    weak_kind = np.zeros(size, np.int8)
    open_ = free & ~strong[row]
    comma = open_ & (data == ord(",")) & ~(_DIGIT[prev] & _DIGIT[nxt])
    amp = open_ & (data == ord("&")) & spaced
    conj = open_ & (data == ord("a")) & (_shift(data, 1) == ord("n")) & (_shift(data, 2) == ord("d")) & space[np.clip(at - 1, 0, size - 1)] & _shift(space, 3, False)
    bare = open_ & slash & (cut_len == 0) & ~space[np.clip(at - 1, 0, size - 1)] & ~_SPACE[nxt] & inside & (at > start[row]) & (at < end[row] - 1)
    for mask, length in ((comma, 1), (amp, 1), (conj, 3), (bare, 1)):
        cut_len[mask] = length
        weak_kind[mask] = 1

    # child offsets: a piece runs from the end of a delimiter to the start of the next one
    hits = np.flatnonzero(cut_len)
    parent = np.concatenate((np.arange(n), row[hits]))
    begin = np.concatenate((start, np.minimum(hits + cut_len[hits], end[row[hits]])))
    is_weak = np.concatenate((np.zeros(n, bool), weak_kind[hits] > 0))
    order = np.lexsort((begin, parent))
    parent, begin, is_weak = parent[order], begin[order], is_weak[order]
    stop_at = np.concatenate((end, hits))[np.lexsort((np.concatenate((end, hits)), np.concatenate((np.arange(n), row[hits]))))]
    stop = np.maximum(stop_at, begin)
    items = _clean(_gather(data, begin, stop))
    full = pc.greater(pc.binary_length(items), 0).to_numpy(zero_copy_only=False)
    parent, begin, stop, is_weak = parent[full], begin[full], stop[full], is_weak[full]
    items = items.filter(pa.array(full))

    # weak boundaries hold only between pieces that stand alone; the others are joined to a neighbour
    weak_row = ~strong & (np.bincount(parent[is_weak], minlength=n) > 0)
    if weak_row.any():
        standing = pc.match_substring_regex(items, OFFICES if offices else r"\S[\s-]+\S").to_numpy(zero_copy_only=False)
        enclosed = quoted[np.clip(ahead[np.clip(begin, 0, size - 1)], 0, size - 1)]
        standing = standing | enclosed | ~weak_row[parent]
        begins = np.concatenate(([True], parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, bool)
        if offices:  # a piece that does not stand alone goes to the one before it
            lead = begins | standing
        else:  # a piece that does not stand alone takes what follows it
            lead = begins | np.concatenate(([True], standing[:-1])) if len(parent) else begins
        group = np.cumsum(lead) - 1
        firsts = np.flatnonzero(lead)
        lasts = np.concatenate((firsts[1:], [len(lead)])) - 1
        any_standing = np.zeros(len(firsts), bool)
        np.logical_or.at(any_standing, group, standing)
        joined_begin, joined_stop, joined_parent = begin[firsts], stop[lasts], parent[firsts]
        many = lasts > firsts
        joined = _clean(_gather(data, joined_begin, joined_stop))
        if not offices:  # the last run must stand too, or the text is one value
            bad = np.zeros(n, bool)
            tail_group = np.concatenate((joined_parent[1:] != joined_parent[:-1], [True])) if len(joined_parent) else np.zeros(0, bool)
            words = pc.match_substring_regex(joined, r"\S[\s-]+\S").to_numpy(zero_copy_only=False)
            bad[joined_parent[tail_group & ~words & ~(enclosed[firsts] & ~many) & weak_row[joined_parent]]] = True
        else:
            bad = np.zeros(n, bool)
            bad[joined_parent[~any_standing & weak_row[joined_parent]]] = True
        keep = ~bad[joined_parent]
        parent, items = joined_parent[keep], joined.filter(pa.array(keep))

    counts = np.bincount(parent, minlength=n)
    several = counts[parent] > 1
    parent, items = parent[several], items.filter(pa.array(several))
    # the list array over the child items; flattened with its parents it gives the rows
    held = np.where(counts > 1, counts, 0)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))), pa.int64()), items)
    ordinal = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    child = np.asarray(lists.offsets)
    return ordinal, np.arange(len(items)) - child[ordinal] + 1, lists.flatten()


#: Bytes of text whose masks are held at a time; a longer text is taken alone, whole.
SLICE_BYTES = 2_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (key, text) in runs of rows of about :data:`SLICE_BYTES` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def split_values(df: DataFrame, key: str, text: str, source_table: str, offices: bool = False) -> DataFrame:
    """(source_table, record_id, pos, item): one row per value of every text of ``df`` that holds at least two.

    A narrow Arrow pass without a shuffle; only the key and the text are read, whatever other columns there are.
    pos counts the non-empty values from 1, repeats included; null keys are kept as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _slices(b)):
            ordinal, pos, items = split_array(batch.column(1), offices)
            ids = batch.column(0).take(pa.array(ordinal)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), items.cast(pa.string())], ["record_id", "pos", "item"])

    rows = df.select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "record_id string, pos int, item string")
    return found.select(F.lit(source_table).alias("source_table"), "record_id", "pos", "item")
