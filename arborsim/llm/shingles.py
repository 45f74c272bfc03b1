"""Word shingles of a batch of texts as 48-bit hashes, in numpy over the batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240501)
#: One random number for each byte (upper and lower case alike), 0 for white space.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_ODD = U64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time (more only where a single word is longer); temporaries take some 30 times as many.
STRETCH = 1 << 18
_LONG = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U64(1)], np.full(n, step)]).astype(U64), dtype=U64)[:n]


_LOW = _powers(_ODD, _LONG)


def _weights(place: np.ndarray, most: int) -> np.ndarray:
    """The weight of each place in a word, of which none is above ``most``."""
    if most < _LONG:
        return _LOW[place]
    with np.errstate(over="ignore"):
        return _LOW[place & (_LONG - 1)] * _powers(_LOW[-1] * _ODD, most // _LONG + 1)[place >> 12]


def _stop(data: np.ndarray, ends: np.ndarray, at: int) -> int:
    """Where the stretch that begins at ``at`` ends: no word goes on there."""
    here = at + STRETCH
    if here >= len(data):
        return len(data)
    end = int(ends[np.searchsorted(ends, here)])
    while here < end:
        blank = _SPACE[data[here : min(end, here + _LONG)]]
        if blank.any():
            return here + int(blank.argmax())
        here += len(blank)
    return end


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word; document i is data[ends[i - 1]:ends[i]]."""
    docs, words, at = [np.zeros(0, np.int32)], [np.zeros(0, U64)], 0
    while at < len(data):
        stop = _stop(data, ends, at)
        some = data[at:stop]
        space = _SPACE[some]
        begins = ~space
        begins[1:] &= space[:-1]
        heads = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, stop)] - at
        begins[heads] = ~space[heads]
        starts = np.flatnonzero(begins)
        if len(starts):
            length = np.diff(starts, append=len(some))
            place = np.arange(starts[0], len(some), dtype=np.int32)
            place -= np.repeat(starts.astype(np.int32), length)
            # blanks count as 0, so a word's stretch may run up to the next word
            terms = _BYTE[some[starts[0] :]]
            terms *= _weights(place, int(length.max()))
            docs.append(np.searchsorted(ends, starts + at, "right").astype(np.int32))
            words.append(mix(np.add.reduceat(terms, starts - starts[0])))
        at = stop
    return np.concatenate(docs), np.concatenate(words)


def bodies(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, nulls having none, and where each value ends in them; nothing is copied without nulls."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token): the distinct shingles of each text of a binary array of at most 65,536, by document and token.

    Texts of fewer words than ``size`` have one shingle of all their words.
    """
    if len(texts) > 1 << 16:
        raise ValueError("more than 65,536 texts at a time")
    with np.errstate(over="ignore"):
        doc, word = word_hashes(*bodies(texts))
        weights = mix(np.arange(1, size + 1, dtype=U64) * _ODD) | U64(1)
        n = len(word) - size + 1
        keys = [np.zeros(0, U64)]
        if n > 0:
            total = np.zeros(n, U64)
            for j in range(size):
                total += word[j : j + n] * weights[j]
            whole = doc[:n] == doc[size - 1 :]
            keys.append(doc[:n][whole].astype(U64) << U64(48) | mix(total[whole]) >> U64(16))
            del total, whole
        count = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(count) - count
        for d in np.flatnonzero((count > 0) & (count < size)):
            ws = word[first[d] : first[d] + count[d]]
            own = mix(np.array([(ws * weights[: len(ws)]).sum(dtype=U64) + U64(len(ws)) * _ODD]))
            keys.append(U64(d) << U64(48) | own >> U64(16))
        del doc, word
        keys = np.concatenate(keys)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> U64(48)).astype(np.int64), keys & U64((1 << 48) - 1)


def set_hash(doc: np.ndarray, token: np.ndarray, docs: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(size, 63-bit hash) of each document's token set."""
    n = np.bincount(doc, minlength=docs)
    with np.errstate(over="ignore"):
        sums = np.zeros(docs, U64)
        has = np.flatnonzero(n)
        if len(has):
            starts = (np.cumsum(n) - n)[has]
            sums[has] = np.add.reduceat(mix(token * _ODD + U64(seed)), starts)
        return n, (mix(sums + n.astype(U64) * _ODD) >> U64(1)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int, rows: int = 1 << 16) -> list[pa.RecordBatch]:
    """Parts of the batch with about so many bytes in a binary column and so many rows at most, one row at least."""
    _, ends = bodies(batch.column(column))
    out, at = [], 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        out.append(batch.slice(at, stop - at))
        at = stop
    return out
