"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the bytes of all pieces drives the Viterbi search: one pass
over the text, and at each byte the output links give every piece that ends there, each of
which relaxes the best score of its end.  Pieces never cross the border between a word
and the mark of the next, so a slice of texts is cut into words with their marks, and
the search runs over all distinct words of the slice at once, byte by byte.  In words of more
than ``LONG`` bytes (texts without spaces) the automaton runs over many stretches of the word at
once, each begun a piece's length early, and only the relaxation goes from byte to byte.

Scores are those that the model file holds.  For a file made by merging pairs they are
ranks, so the result is the segmentation of the largest total, not the merge order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import in_small_batches

MARK = "▁".encode()
LONG, STRETCH, BLOCK = 512, 1024, 1 << 16
SLICE = 512 << 10


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, read on the driver and sent to the tasks."""

    def __init__(self, pieces: list[bytes], scores: list[float], ids: list[int], byte_ids: list[int], unknown: int, texts: dict[int, bytes]):
        self.pieces, self.scores, self.ids, self.byte_ids, self.unknown, self.texts = pieces, scores, ids, byte_ids, unknown, texts
        self.key = hash((tuple(pieces), tuple(scores), tuple(byte_ids)))

    def __hash__(self):
        return self.key

    def __eq__(self, other):
        return self.key == other.key

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, ids, texts, byte_ids = [], [], [], {}, [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append(piece.encode())
                scores.append(model.get_score(i))
                ids.append(i)
                texts[i] = piece.encode()
        return cls(pieces, scores, ids, byte_ids, model.unk_id(), texts)


class Automaton:
    """Dense transitions over bytes, and for each state the longest piece that ends there
    with a link to the next shorter one."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = vocabulary.pieces
        size = np.array([len(p) for p in pieces], np.int64)
        data, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        # trie states level by level: a state is a (state above, byte) that some piece takes
        at, levels, n = np.zeros(len(pieces), np.int64), [], 1
        for depth in range(int(size.max(initial=0))):
            deep = np.flatnonzero(size > depth)
            keys, which = np.unique(at[deep] * 256 + data[start[deep] + depth], return_inverse=True)
            at[deep] = n + which
            levels.append((keys >> 8, keys & 255, np.arange(n, n + len(keys))))
            n += len(keys)
        piece_of = np.full(n, -1, np.int32)
        piece_of[at] = np.arange(len(pieces))
        self.go = np.zeros((n, 256), np.uint16 if n < 1 << 16 else np.int32)
        fail, link = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for depth, (above, byte, state) in enumerate(levels):
            if depth:  # the longest proper suffix lies in a shallower level, which is complete
                fail[state] = self.go[fail[above], byte]
            f = fail[state]
            link[state] = np.where(piece_of[f] >= 0, f, link[f])
            self.go[above, byte] = state
            for lot in range(0, len(state), 4096):
                self.go[state[lot : lot + 4096]] = self.go[f[lot : lot + 4096]]
        self.first = np.where(piece_of >= 0, np.arange(n, dtype=np.int32), link)  # state that names the longest piece here, or -1
        self.link, self.piece_of = link, piece_of
        self.length = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.score = np.array(vocabulary.scores, np.float64)
        self.id = np.array(vocabulary.ids, np.int64)
        self.fallback = (min(vocabulary.scores, default=0.0)) - 10.0  # of a byte that no piece covers
        self.lists = self.length.tolist(), self.score.tolist()


@lru_cache(maxsize=2)
def automaton(vocabulary: Vocabulary) -> Automaton:
    return Automaton(vocabulary)


K.CACHES.append(automaton.cache_clear)


def viterbi(machine: Automaton, data: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray, long: int = LONG):
    """Best segmentation of each span of ``data``: the pieces' numbers back to back (-1 - byte
    for a byte of its own) and how many each span has.

    ``plain`` marks bytes that no piece may cover.  Whole characters fall back to bytes, at
    ``fallback`` each character; ties keep the longer last piece.  Spans of more than ``long`` bytes go one by one.
    """
    far = np.flatnonzero(size > long)
    if not len(far):
        return _together(machine, data, start, size, plain)
    near = np.flatnonzero(size <= long)
    pieces, many = _together(machine, data, start[near], size[near], plain)
    parts = np.split(pieces, np.cumsum(many)[:-1]) if len(near) else []
    out: list = [None] * len(start)
    for i, part in zip(near, parts):
        out[i] = part
    for i in far:
        at = slice(start[i], start[i] + size[i])
        out[i] = _alone(machine, data[at], plain[at])
    return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _states(machine: Automaton, data: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The automaton's state after each byte.  It depends on the last bytes only, as many as the longest
    piece has, so stretches of the text run side by side."""
    n, early = len(data), int(machine.length.max(initial=0))
    first = np.arange(0, n, STRETCH)
    out, state = np.zeros(n, np.int32), np.zeros(len(first), np.int32)
    for step in range(-early, STRETCH):
        at = first + step
        ok = (at >= 0) & (at < n)
        at = np.where(ok, at, 0)
        state = np.where(ok & ~plain[at], machine.go[state, data[at]], 0)
        if step >= 0:
            out[at[ok]] = state[ok]
    return out


def _alone(machine: Automaton, data: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Best segmentation of one long span, as numbers of pieces."""
    n = len(data)
    states = _states(machine, data, plain)
    leads = (data & 0xC0) != 0x80
    closes = np.append(leads[1:], True).tolist()
    lead = np.maximum.accumulate(np.where(leads, np.arange(n), 0)).tolist()
    length, score = machine.lists
    best, back = [0.0], [0]
    for low in range(0, n, BLOCK):
        node = machine.first[states[low : low + BLOCK]]
        ends, pieces = [], []
        live = np.flatnonzero(node >= 0)
        while live.size:
            ends.append(live)
            pieces.append(machine.piece_of[node[live]])
            node[live] = machine.link[node[live]]
            live = live[node[live] >= 0]
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")  # longer pieces stay in front
        piece = np.concatenate(pieces)[order].tolist() if ends else []
        border = np.searchsorted(end[order], np.arange(len(node) + 1)).tolist()
        for at in range(len(node)):
            place = low + at + 1
            top, won = -np.inf, 0
            for p in piece[border[at] : border[at + 1]]:
                value = best[place - length[p]] + score[p]
                if value > top:
                    top, won = value, p
            if closes[place - 1]:
                value = best[lead[place - 1]] + machine.fallback
                if value > top:
                    top, won = value, lead[place - 1] - place - 1
            best.append(top)
            back.append(won)
    out, where = [], n
    while where > 0:
        step = back[where]
        if step >= 0:
            out.append(step)
            where -= length[step]
        else:
            out.extend((-1 - data[where + step + 1 : where][::-1].astype(np.int64)).tolist())
            where += step + 1
    return np.array(out[::-1], np.int64)


def _together(machine: Automaton, data: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray):
    n = len(start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if n else np.zeros(0, np.int64)
    total = int((size + 1).sum())
    best, back = np.full(total, -np.inf), np.zeros(total, np.int64)
    best[base] = 0.0
    state, active = np.zeros(n, np.int64), n
    lead = np.zeros(n, np.int64)  # where the character that is being read begins
    for at in range(int(size.max(initial=0))):
        while active and size[active - 1] <= at:
            active -= 1
        b = data[start[:active] + at]
        off_limits = plain[start[:active] + at]
        lead[:active] = np.where((b & 0xC0) != 0x80, at, lead[:active])
        state[:active] = np.where(off_limits, 0, machine.go[state[:active], b])
        end = base[:active] + at + 1
        node = machine.first[state[:active]]
        while (live := np.flatnonzero(node >= 0)).size:
            piece = machine.piece_of[node[live]]
            value = best[end[live] - machine.length[piece]] + machine.score[piece]
            better = value > best[end[live]]
            won = live[better]
            best[end[won]], back[end[won]] = value[better], piece[better]
            node[live] = machine.link[node[live]]
        # a character may always stand as its bytes
        closes = np.ones(active, bool)
        more = size[:active] > at + 1
        closes[more] = (data[start[:active][more] + at + 1] & 0xC0) != 0x80
        c = np.flatnonzero(closes)
        value = best[base[c] + lead[c]] + machine.fallback
        better = value > best[end[c]]
        won = c[better]
        best[end[won]], back[end[won]] = value[better], -1 - (at + 1 - lead[won])
    # walk back from every end at once
    where, spans, steps = size.copy(), [], []
    live = np.arange(n)
    while (live := live[where[live] > 0]).size:
        step = back[base[live] + where[live]]
        width = np.where(step >= 0, machine.length[np.maximum(step, 0)], -1 - step)
        bytes_ = step < 0
        spans.append(live[~bytes_])
        steps.append(np.column_stack([where[live][~bytes_], step[~bytes_]]))
        many = width[bytes_]
        owner = np.repeat(live[bytes_], many)
        place = K.ranges(where[live[bytes_]] - many, many)
        spans.append(owner)
        steps.append(np.column_stack([place + 1, -1 - data[start[owner] + place].astype(np.int64)]))
        where[live] -= width
    owner = np.concatenate(spans) if spans else np.zeros(0, np.int64)
    both = np.concatenate(steps) if steps else np.zeros((0, 2), np.int64)
    owner = order[owner]
    by = np.lexsort((both[:, 0], owner))
    return both[by, 1], np.bincount(owner, minlength=n)


def _marked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a mark in front and for each space; True for bytes of marks that were
    written in the text, which must stay bytes so that decoding gives them back."""
    body, sizes, own = [], [], []
    for t in texts:
        if not t:
            sizes.append(0)
            continue
        raw = t.encode()
        if MARK in raw:
            own.append((len(sizes), raw))
        marked = MARK + raw.replace(b" ", MARK)
        body.append(marked)
        sizes.append(len(marked))
    data = np.frombuffer(b"".join(body), np.uint8)
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    plain = np.zeros(len(data), bool)
    for i, raw in own:
        text = np.frombuffer(raw, np.uint8)
        wide = np.where(text == 0x20, 3, 1)
        place = off[i] + 3 + np.cumsum(wide) - wide
        at = raw.find(MARK)
        while at >= 0:
            plain[place[at : at + 3]] = True
            at = raw.find(MARK, at + 3)
    return data, off, plain


def encode_texts(machine: Automaton, vocabulary: Vocabulary, texts: list[str | None]):
    """Ids of all texts back to back, and offsets.  Null and empty texts have none."""
    data, off, plain = _marked(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    is_mark = np.zeros(len(data) + 1, bool)
    is_mark[: len(data) - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    is_mark[: len(data)] &= ~plain
    inside = is_mark.copy()  # any byte of a mark
    inside[1:] |= is_mark[:-1]
    inside[2:] |= is_mark[:-2]
    head = is_mark[: len(data)].copy()
    head[1:] &= ~inside[: len(data) - 1]  # a run of marks goes with the word after it
    head[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(data)))
    # word hashes tell the distinct words; written marks differ from spaces
    shown = np.where(plain, 1, data).astype(np.uint8)
    _, lead, which = np.unique(K.span_hashes(shown, start, start + size), return_index=True, return_inverse=True)
    twin = lead[which]
    if (size != size[twin]).any() or (shown != shown[K.ranges(start[twin], size)]).any():  # a hash has lied
        raw = shown.tobytes()
        _, lead, which = np.unique(np.array([raw[a : a + b] for a, b in zip(start, size)], object), return_index=True, return_inverse=True)
    pieces, many = viterbi(machine, data, start[lead], size[lead], plain)
    first = np.cumsum(many) - many
    numbers = pieces[K.ranges(first[which], many[which])]
    byte_ids = np.array(vocabulary.byte_ids)
    ids = np.where(numbers >= 0, machine.id[np.maximum(numbers, 0)], byte_ids[np.maximum(-1 - numbers, 0)])
    ids = np.where(ids < 0, vocabulary.unknown, ids)
    run = np.concatenate(([0], np.cumsum(many[which])))
    return ids, run[np.searchsorted(start, off)]


@lru_cache(maxsize=2)
def _piece_bytes(vocabulary: Vocabulary):
    """Bytes of every id, spaces for marks, back to back."""
    n = max([*vocabulary.texts, vocabulary.unknown]) + 1
    own = set(vocabulary.byte_ids)
    parts = [b if i in own else b.replace(MARK, b" ") for i in range(n) for b in [vocabulary.texts.get(i, b"")]]
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Text of each list of ids; the space in front is dropped, control ids are nothing."""
    data, start, size = _piece_bytes(vocabulary)
    raw = data[K.ranges(start[ids], size[ids])].tobytes()
    run = np.concatenate(([0], np.cumsum(size[ids])))
    out = [raw[run[a] : run[b]] for a, b in zip(off[:-1], off[1:])]
    return [x[1:] if x[:1] == b" " else x for x in out]


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) of each whole text under the SentencePiece model file
    at the path ``model`` (read on the driver); with ``decoded`` also ``text``, what the ids
    decode to, from the same task.

    Null and empty texts have no ids.  Characters that no piece covers become byte pieces
    (or the unknown piece if the model has none); so does a written U+2581, which would
    otherwise come back as a space.
    """
    vocabulary = Vocabulary.load(model)

    def run(batches):
        machine = automaton(vocabulary)
        for batch in batches:
            for part in K.slices(batch, size=SLICE):
                ids, off = encode_texts(machine, vocabulary, part.column("text").to_pylist())
                columns = [part.column("doc_id"), _lists(ids, off)]
                if decoded:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in decode_ids(vocabulary, ids, off)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: 2 + decoded])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(K.lean(run), "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of each list of ``ids``; a null list gives an empty text.  Bytes that
    do not form UTF-8 become U+FFFD, ids outside the model nothing."""
    vocabulary = Vocabulary.load(model)

    def run(batches):
        size = len(_piece_bytes(vocabulary)[2])
        for batch in batches:
            column = batch.column("ids")
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            off = column.offsets.to_numpy().astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (ids >= 0) & (ids < size)
            run_ = np.concatenate(([0], np.cumsum(keep)))
            texts = decode_ids(vocabulary, ids[keep], run_[off - off[0]])
            columns = [batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(K.lean(run), "doc_id long, text string")
