"""Counts of a text by numpy: words, symbols, repeated lines, repeated windows, letters, cases."""

import numpy as np

from cinderflow.llm import textkernel as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_COMMA = np.zeros(256, bool)
_COMMA[list(b",;:")] = True
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
COMMON = "the of and to in a is that it for on was as with be by are this der die und das ist von zu den mit des le la les de et que un une en el los las y del se por con"
_COMMON = np.array(sorted(set(K.hash_text(COMMON))), np.uint64)

#: Counts in the order of the matrix that counts() returns.
NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "letters", "upper", "digits", "ends", "commas", "wide", "distinct",
    "common", "bare", "longest", "upper_words", "sum_sq_length", "bytes", "blank_lines",
]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values over edges[i] .. edges[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(w: K.Words, firsts: np.ndarray) -> np.ndarray:
    """Words in windows of WINDOW words that occur twice or more in their text."""
    at, g = w.grams(WINDOW)
    covered = np.zeros(len(w.doc) + 1, np.int64)
    if len(at):
        doc = w.doc[at].astype(np.uint64)
        key = K.mix(g + doc * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, firsts)


def _lines(data: np.ndarray, offsets: np.ndarray, w: K.Words, n: int):
    """Per text: lines with a word, those equal to an earlier line of the text, lines without a word."""
    at = np.flatnonzero(data == 10)
    # lines begin at each text's begin and after each line feed
    begin = np.concatenate([offsets[:-1], at + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, at, "right") - 1])
    order = np.argsort(doc.astype(np.int64) * (len(data) + 2) + begin, kind="stable")
    begin, doc = begin[order], doc[order]
    end = np.empty_like(begin)
    end[:-1] = np.where(doc[1:] == doc[:-1], begin[1:] - 1, offsets[doc[:-1] + 1])
    if len(end):
        end[-1] = offsets[-1]
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    h = hash_spans(data, begin[has], end[has])
    key = K.mix(h + doc[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[first] = False
    return np.bincount(doc[has], minlength=n), np.bincount(doc[has], weights=dup, minlength=n).astype(np.int64), np.bincount(doc[~has], minlength=n)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin[i]:end[i]] as it is; spans don't overlap and stand in order."""
    out = np.zeros(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + K._SEGMENT, "right")))
        lo, hi = int(begin[i]), int(end[j - 1])
        seg = data[lo:hi].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * K._power("up", K._BASE, len(seg)), out=sums[1:])
        h = (sums[end[i:j] - lo] - sums[begin[i:j] - lo]) * K._power("down", K._INVERSE, len(seg) + 1)[begin[i:j] - lo]
        out[i:j] = K.mix(h + (end[i:j] - begin[i:j]).astype(np.uint64) * K._PLACES[31])
        i = j
    return out


def counts(column) -> np.ndarray:
    """A row of NAMES for each text of an Arrow column; null counts as empty."""
    data, offsets = K.flat(column)
    out = [_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.parts(offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    w = K.words(data, offsets)
    # Repeated windows are of words as they stand; all else goes by lower-cased words.
    exact = K.Words(n, w.doc, w.start, w.end, hash_spans(data, w.start, w.end))
    firsts = w.firsts()
    per_byte = lambda table: _sums(table[data], offsets)
    seen = lambda table: (t := np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)]))[w.end] - t[w.start]
    length = (w.end - w.start) - seen(_CONTINUES)
    letters, upper = seen(_LETTER), seen(_UPPER)
    # Distinct words of a text: first places of (text, word) in sorted order.
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    lines, dups, blanks = _lines(data, offsets, w, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, length)
    by_word = lambda x: np.bincount(w.doc, weights=x, minlength=n).astype(np.int64)
    return np.stack(
        [
            np.diff(firsts), by_word(length), per_byte(SYMBOLS), dups, _repeated(exact, firsts), lines, per_byte(_LETTER), per_byte(_UPPER), per_byte(_DIGIT),
            per_byte(_ENDS), per_byte(_COMMA), _sums(data >= 0x80, offsets), np.bincount(d[new], minlength=n), by_word(np.isin(w.hash, _COMMON)),
            by_word(letters == 0), longest, by_word((upper == letters) & (letters > 1)), by_word(length * length), np.diff(offsets), blanks,
        ],
        axis=1,
    )
