"""BPE encoding by prefix-sharing trie traversal.

For BPE by merge ranks, the encoding of a prefix is fixed by its last token: the encoding of ``s[:d]`` is that of
``s[:d - len(t)]`` followed by ``t``, for the one vocabulary token ``t`` that ends at ``d``, encodes to itself and stands
stably after the last token of the shorter prefix. So the distinct words of a block of rows go into a trie, a depth-first
walk sets (last token, its length) at each node from the nodes above, and every shared prefix is worked out once.

A token that ends a word differs from the same characters inside one (``</w>``), so leaves hang below the node of all
but the last symbol. Words are found again in a cache of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrowtext import Chunk, chunks, column, raw, release

#: Rows with other characters than these go through the library's own normaliser and splitter: code points below U+0240 are in NFC
#: whatever their neighbours are and are lower-cased alike everywhere, but for U+0130; four control characters are white space to some.
_PLAIN_BELOW = 0x240
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CACHED_WORDS = 1_000_000
#: Words in one trie; its nodes are small dicts, of which memory would hold millions.
_TRIE_WORDS = 16_384
_CHUNK_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """The splitter's class of each plain code point."""
    out = np.full(_PLAIN_BELOW, _OTHER, dtype=np.uint8)
    for c in range(_PLAIN_BELOW):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if c in (*range(9, 14), 0x20, 0x85, 0xA0) else {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    return out


#: The splitter that split_words() follows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLASS = _classes()
_ODD_LEAD = np.zeros(256, dtype=bool)
_ODD_LEAD[[*range(0x1C, 0x20), *range(0xC9, 256)]] = True


def _odd_rows(c: Chunk) -> np.ndarray:
    odd = _ODD_LEAD[c.data]
    odd[:-1] |= (c.data[:-1] == 0xC4) & (c.data[1:] == 0xB0)
    odd[:-1] |= (c.data[:-1] == 0xC8) & ((c.data[1:] == 0xBA) | (c.data[1:] == 0xBE))
    return c.per_row(odd) > 0


def split_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of lower-cased plain rows: runs of letters, single numbers, runs of other characters, and the
    contractions 's 't 're 've 'm 'll 'd where nothing of the third kind stands before their apostrophe."""
    data = c.data
    code = data.astype(np.uint16)
    lead = np.flatnonzero(data >= 0xC0)
    code[lead] = ((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)
    code[lead + 1] = code[lead]
    kind = _CLASS[np.minimum(code, _PLAIN_BELOW - 1)]
    opens = (data & 0xC0) != 0x80
    before = np.full(len(data), 255, dtype=np.uint8)
    before[1:] = kind[:-1]
    edge = c.at[:-1]
    before[edge[edge < len(data)]] = 255
    breaks = np.ones(len(data) + 1, dtype=bool)
    breaks[:-1] = opens & ((kind == _NUMBER) | (kind != before))
    bound = np.flatnonzero(breaks)
    opening = np.flatnonzero(kind[bound[:-1]] != _SPACE)
    start, end = bound[opening], bound[opening + 1]
    row = c.row_of(start)
    q = np.flatnonzero((end[:-1] - start[:-1] == 1) & (data[start[:-1]] == ord("'")) & (start[1:] == end[:-1]) & (row[1:] == row[:-1]) & (kind[start[1:]] == _LETTER)) if len(start) > 1 else []
    if len(q):
        first = data[start[q + 1]]
        second = np.where(end[q + 1] - start[q + 1] > 1, data[np.minimum(start[q + 1] + 1, len(data) - 1)], 0)
        two = (np.isin(first, [ord("r"), ord("v")]) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        by = np.where(np.isin(first, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
        end[q] += by
        start[q + 1] += by
        full = start < end
        start, end, row = start[full], end[full], row[full]
    return start, end, row


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE's symbol of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TrieEncoder:
    """Encoder for a ``tokenizers`` file of a lower-casing BPE with word ends. Not for other kinds of file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: a BPE with word ends and no decoder is needed")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.joined, self.parts = {}, {}
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ids = self.vocab[left], self.vocab[right]
            self.joined[ids] = self.vocab[left + right]
            self.parts[self.vocab[left + right]] = ids
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _PATTERN:
            raise ValueError(f"{path}: its splitter is not the one that split_words() follows")
        self._library = Tokenizer.from_file(path)
        self._bytes = {x: b for b, x in _byte_symbols().items()}
        self._symbols = str.maketrans({chr(b): s for b, s in _byte_symbols().items()})
        self._sound: dict[int, bool] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._starts = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self._steps: dict[str, dict] = {}
        self._forget()

    # -- words of a text ---------------------------------------------------------------------------------------

    def _odd_words(self, text: str) -> list[bytes]:
        """The words of any text, by the library's normaliser and splitter; special tokens stand as themselves."""
        out: list[bytes] = []
        for piece in self._special.split(text) if self._special else [text]:
            if piece in self.special:
                out.append(piece.encode())
            elif piece:
                found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))
                out.extend(bytes(map(self._bytes.__getitem__, w)) for w, _ in found)
        return out

    # -- last-token states -------------------------------------------------------------------------------------

    def _stands(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, stay these two."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) > 400_000:
                self._stable.clear()
            known = self._stable[left, right] = self._border_holds(left, right, 1 << 62)
        return known

    def _border_holds(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge earlier than ``limit`` joins symbols across the border of the two tokens."""
        joined, parts, a, b, ok = self.joined, self.parts, left, right, None
        while ok is None:
            both = joined.get((a, b))
            if both is not None and both < limit:
                ok = False
            elif a > b:  # undo the later of the two last merges, next to the border
                limit = a
                if a in parts:
                    a = parts[a][1]
                else:
                    limit = b + 1
                    ok, b = (None, parts[b][0]) if b in parts else (True, b)
            else:
                limit = b + 1
                if b in parts:
                    b = parts[b][0]
                else:
                    limit = a
                    ok, a = (None, parts[a][1]) if a in parts else (True, a)
        return ok

    def _encodes_itself(self, token: int) -> bool:
        known = self._sound.get(token)
        if known is None:
            known = token not in self.parts or (all(map(self._encodes_itself, self.parts[token])) and self._border_holds(*self.parts[token], token))
            self._sound[token] = known
        return known

    def _step(self, state: str, symbol: str) -> tuple[str, list[tuple[int, int]]]:
        """From the longest suffix of a path that starts a token, by one more symbol: the next such suffix, and (token, size) of the tokens
        that end there and encode to themselves."""
        path = state + symbol
        while path not in self._starts and len(path) > 1:
            path = path[1:]
        whole, extra = state + symbol, len(symbol) - 1
        ending = []
        for k in range(len(whole) - extra - 1, -1, -1):
            token = self.vocab.get(whole[k:])
            if token is not None and self._encodes_itself(token):
                ending.append((token, len(whole) - k - extra))
        return path, ending

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words, by depth-first walks over tries of neighbours in their order."""
        collecting = gc.isenabled()
        gc.disable()  # the trie's many small dicts hold no cycles
        try:
            ordered, out = sorted(words), {}
            for lo in range(0, len(ordered), _TRIE_WORDS):
                out |= self._walk(ordered[lo : lo + _TRIE_WORDS])
            return out
        finally:
            if collecting:
                gc.enable()

    def _walk(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        root: dict = {}
        deepest, end = 0, self.end
        for word in words:
            text = word.decode("latin-1")
            if not (word.isascii() and text.isprintable()):
                text = text.translate(self._symbols)
            node = root
            for symbol in text[:-1]:
                below = node.get(symbol)
                if below is None:
                    below = node[symbol] = {}
                node = below
            node[text[-1] + end] = word
            deepest = max(deepest, len(word))
        last, size = [0] * (deepest + 1), [0] * (deepest + 1)
        out: dict[bytes, tuple[int, ...]] = {}
        steps, stands = self._steps, self._stable
        todo = [(0, "", root, 0, 0)]
        while todo:
            depth, state, below, last[depth], size[depth] = todo.pop()
            moves = steps.get(state)
            if moves is None:
                moves = steps[state] = {}
            depth += 1
            waiting = []
            for symbol, node in below.items():
                move = moves.get(symbol)
                if move is None:
                    move = moves[symbol] = self._step(state, symbol)
                for token, n in move[1]:
                    if n == depth:
                        break
                    left = last[depth - n]
                    ok = stands.get((left, token))
                    if ok is None:
                        ok = self._stands(left, token)
                    if ok:
                        break
                else:
                    raise ValueError("no token ends a prefix; the file's merges and vocabulary differ")
                if node.__class__ is bytes:
                    ids, at = [token], depth - n
                    while at:
                        ids.append(last[at])
                        at -= size[at]
                    ids.reverse()
                    out[node] = tuple(ids)
                else:
                    waiting.append((depth, move[0], node, token, n))
            todo.extend(waiting)
        return out

    # -- texts -------------------------------------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> "Encoded":
        """Encode some rows of text without nulls. Words are told apart by 64-bit hashes."""
        source = Chunk(*raw(texts), 0, len(texts))
        odd = _odd_rows(source)
        for special in self.special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        c = Chunk(*raw(pc.utf8_lower(plain)), 0, len(texts))
        start, end, row = split_words(c)
        hashes, body = c.hashes(start, end), c.data.tobytes()
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        if odd.any():
            found = {k: self._odd_words(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
            more = [w for k in sorted(found) for w in found[k]]
            ends = np.cumsum([len(w) for w in more], dtype=np.int64)
            begins = ends - np.array([len(w) for w in more], dtype=np.int64)
            extra = np.frombuffer(b"".join(more), np.uint8)
            count = np.diff(at)
            count[list(found)] = [len(found[k]) for k in found]
            place = np.repeat(odd, count)
            joined = [np.zeros(len(place), x.dtype) for x in (hashes, start, end)]
            other = Chunk(extra, np.array([0, len(extra)]), 0, 1).hashes(begins, ends), begins + len(body), ends + len(body)
            for whole, usual, special in zip(joined, (hashes, start, end), other):
                whole[~place], whole[place] = usual, special
            hashes, start, end = joined
            body += extra.tobytes()
            at = np.concatenate([[0], np.cumsum(count)])
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(keys, first, start, end, body)
        k = np.searchsorted(self._keys, keys)
        begin, size = self._begin[k].astype(np.int64), self._size[k].astype(np.int64)
        ends = np.cumsum(size)
        flat = self._ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        return Encoded(flat, size, which, at)

    def _learn(self, keys: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, body: bytes) -> None:
        """Encode the words that are not known yet."""
        if len(self._keys) > _CACHED_WORDS:
            self._forget()
        k = np.searchsorted(self._keys, keys)
        missing = np.flatnonzero(self._keys[np.minimum(k, len(self._keys) - 1)] != keys) if len(self._keys) else np.arange(len(keys))
        if not len(missing):
            return
        words = [body[a:b] for a, b in zip(start[first[missing]].tolist(), end[first[missing]].tolist())]
        special = {k.encode(): (i,) for k, i in self.special.items()}
        ids = self.encode_words([w for w in words if w not in special]) | special
        new = [ids[w] for w in words]
        size = np.array([len(x) for x in new], dtype=np.int64)
        begin = len(self._ids) + np.cumsum(size) - size
        self._ids = np.concatenate([self._ids, np.array([i for x in new for i in x], dtype=np.uint32)])
        keys = np.concatenate([self._keys, keys[missing]])
        order = np.argsort(keys, kind="stable")
        self._keys, self._begin, self._size = keys[order], np.concatenate([self._begin, begin.astype(np.int32)])[order], np.concatenate([self._size, size.astype(np.int32)])[order]

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._begin, self._size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)


class Encoded:
    """Token ids of some rows: the ids of their distinct words, how many each has, and which word stands where."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, which: np.ndarray, at: np.ndarray):
        self._flat, self._size, self.which, self.at = flat, size, which, at

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the n + 1 offsets of the rows among them."""
        begin = np.cumsum(self._size) - self._size
        size = self._size[self.which]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) + np.repeat(begin[self.which] - ends[:-1], size)
        return self._flat[place], ends[self.at]

    def joined(self, name_of: Callable[[int], str]) -> list[str]:
        """Each row's ids by name, joined by single spaces."""
        names = list(map(name_of, self._flat.tolist()))
        ends = np.cumsum(self._size).tolist()
        words = [" ".join(names[a:b]) for a, b in zip([0, *ends], ends)]
        which, at = self.which.tolist(), self.at.tolist()
        return [" ".join([words[k] for k in which[a:b]]) for a, b in zip(at, at[1:])]


def encoder(tokenizer: str) -> TrieEncoder:
    """The encoder of a file, or of a name that ``public_tokenizers`` knows where the task runs; one for each worker."""
    if tokenizer not in _ENCODERS:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _ENCODERS[tokenizer] = TrieEncoder(path)
    return _ENCODERS[tokenizer]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoded(batches: Iterable[pa.RecordBatch], tokenizer: str, id_col: str, text_col: str) -> Iterator[tuple[pa.Array, Encoded]]:
    """The ids of some rows at a time with the encoding of their texts."""
    coder = encoder(tokenizer)
    for batch in batches:
        ids, texts = column(batch, id_col).cast(pa.int64()), column(batch, text_col)
        for lo, hi in chunks(raw(texts)[1], _CHUNK_BYTES):
            yield ids[lo:hi], coder.encode(texts[lo:hi])
            release()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): each whole text's token ids, and what decoding them gives. Null text is empty; repeated rows
    give repeated results; other columns are ignored."""

    def run(batches):
        name = encoder(tokenizer).text_of.__getitem__
        for keys, e in encoded(batches, tokenizer, id_col, text_col):
            ids, at = e.ids()
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype(np.int32))), pa.array(e.joined(name), pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding as ``encode_decode``, of which only n_tokens and SHA-256 digests leave the task."""

    def digests(texts: list[str]) -> pa.Array:
        return pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())

    def run(batches):
        name = encoder(tokenizer).text_of.__getitem__
        for keys, e in encoded(batches, tokenizer, id_col, text_col):
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(e.ids()[1])), digests(e.joined(str)), digests(e.joined(name))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
