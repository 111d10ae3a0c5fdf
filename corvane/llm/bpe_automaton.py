"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts as one state with a loop for every base symbol. Each
merge (u, v), in rank order, is one gadget: the state reached by u loses its
arc v, and every state with an arc u gets an arc uv, leading where v led. What
is left accepts exactly the token sequences that merging by rank produces, one
for each string. Rows of states are bit sets over tokens; a token's arcs all
lead to one state, so the table is a bit matrix (state, token) and a vector
(token -> state).

A pre-split word is encoded by transitions only: every prefix of a word has one
accepted token sequence, so a position holds one state, and walking the trie of
arc labels from it finds the arcs that leave it. Whole batches of distinct
words move through these tables together. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Lower cases of letters that Unicode has given one since version 15, which the library knows and str.lower does not.
_NEWER_CASES = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest are counted up from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Automaton:
    """Bit matrix of arcs, target state of each token's arcs, and the trie of arc labels.

    Symbols 0-255 are bytes, 256-511 a word's last byte. ``labels[t]`` is the
    token's label, ``token_ids[t]`` its id in the vocabulary.
    """

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        index = {s: i for i, s in enumerate(symbols)}
        spell = [(i,) for i in range(len(symbols))]
        labels = list(symbols)
        arcs = np.zeros((len(symbols) + len(merges), 64), np.uint8)  # token rows over states, a bit each
        arcs[: len(symbols), 0] = 1
        target, users, free, states = [0] * len(symbols), {0: len(symbols) + 1}, [], 1
        for left, right in merges:
            u, v = index[left], index[right]
            p = target[u]
            if not arcs[v, p >> 3] >> (p & 7) & 1:
                continue  # an earlier merge always takes one of the two: no text has this token
            t = len(labels)
            if left + right in index:
                raise ValueError(f"two merges make {left + right!r}")
            index[left + right] = t
            labels.append(left + right)
            spell.append(spell[u] + spell[v])
            target.append(target[v])
            users[target[v]] += 1
            if users[p] > 1:
                users[p] -= 1
                new = free.pop() if free else states
                states = max(states, new + 1)
                if new >= arcs.shape[1] * 8:
                    arcs = np.concatenate([arcs, np.zeros_like(arcs)], 1)
                bit = (arcs[:t, p >> 3] >> (p & 7)) & 1
                arcs[:t, new >> 3] = arcs[:t, new >> 3] & np.uint8(255 ^ (1 << (new & 7))) | bit << (new & 7)
                users[new], target[u], p = 1, new, new
            arcs[v, p >> 3] &= 255 ^ (1 << (p & 7))
            arcs[t] = arcs[u]
        self.labels = labels
        self.arcs = np.ascontiguousarray(arcs[: len(labels), : (states + 7) // 8])
        self.target = np.array(target, np.int32)
        self.lengths = np.array([len(s) for s in spell], np.int64)
        self._trie(spell)

    def _trie(self, spell: list[tuple[int, ...]]) -> None:
        """The labels' trie as a double array: the child of node n by symbol s is ``base[n] + s`` where ``check`` there is n."""
        children: dict[tuple[int, ...], dict[int, tuple[int, ...]]] = {(): {}}
        for symbols in spell:
            for k in range(len(symbols)):
                children.setdefault(symbols[: k + 1], {})
                children[symbols[:k]][symbols[k]] = symbols[: k + 1]
        token_of = {symbols: t for t, symbols in enumerate(spell)}
        size = 2 * len(children) + 4096
        base, check, token_at, taken = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
        taken[:513] = True  # the root, and room for bases below it
        place, first = {(): 0}, 513
        for node in sorted(children, key=lambda n: (len(n), -len(children[n]), n)):
            if not (below := children[node]):
                continue
            symbols = np.fromiter(below, np.int32, len(below))
            while taken[first]:
                first += 1
            at = first
            while True:
                free = at + np.flatnonzero(~taken[at : at + 1024])
                fits = free[~taken[(free - symbols[0])[:, None] + symbols].any(1)] if len(symbols) > 1 else free
                if len(fits):
                    break
                at += 1024
            base[place[node]] = b = int(fits[0]) - int(symbols[0])
            for s, child in below.items():
                place[child] = b + s
                check[b + s], taken[b + s] = place[node], True
                token_at[b + s] = token_of.get(child, -1)
        self.base, self.check, self.token_at = base, check, token_at

    def encode(self, words: list[bytes], last_marked: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(tokens, offsets)``: word i's token numbers are tokens[offsets[i]:offsets[i+1]]; ``last_marked``: a word's last byte is a symbol of its own."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        lo, parts, counts = 0, [], np.zeros(len(words), np.int64)
        while lo < len(words):  # as many words of like size as make about 2 ** 18 cells
            hi = lo + 1
            while hi < len(words) and (hi - lo + 1) * (sizes[order[hi]] + 1) <= 1 << 18:
                hi += min(1 + (hi - lo) // 2, len(words) - hi)
            some = order[lo : min(hi, len(words))]
            tokens, n = self._encode([words[i] for i in some], sizes[some], last_marked)
            parts.append(tokens)
            counts[some] = n
            lo += len(some)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        sorted_tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        out = np.empty(len(sorted_tokens), np.int32)
        n = counts[order]
        starts = np.cumsum(n) - n
        out[np.repeat(offsets[order] - starts, n) + np.arange(len(out))] = sorted_tokens
        return out, offsets

    def _encode(self, words: list[bytes], sizes: np.ndarray, last_marked: bool) -> tuple[np.ndarray, np.ndarray]:
        width, rows = int(sizes[-1]), len(words)
        if width > 50 * rows:  # few long words: step by step costs less than by columns
            got = [self._encode_one(w, last_marked) for w in words]
            return np.array([t for g in got for t in g], np.int32), np.array([len(g) for g in got], np.int64)
        flat = np.zeros((rows, width + 1), np.int32)
        column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[np.repeat(np.arange(rows), sizes), column] = np.frombuffer(b"".join(words), np.uint8)
        if last_marked:
            full = np.flatnonzero(sizes)
            flat[full, sizes[full] - 1] += 256
        state = np.full((width + 1, rows), -1, np.int32)
        state[0] = 0
        via = np.full((width + 1, rows), -1, np.int32)
        flat = np.ascontiguousarray(flat.T)
        for i in range(width):
            at = np.searchsorted(sizes, i, side="right")  # words are in order of size
            row = at + np.flatnonzero(state[i, at:] >= 0)
            node, depth, here = np.zeros(len(row), np.int32), i, state[i, row]
            while len(row):
                child = self.base[node] + flat[depth, row]
                found = self.check[child] == node
                if depth == i:  # the root's children all exist
                    found = np.ones(len(row), bool)
                row, node, here = row[found], child[found], here[found]
                depth += 1
                token = self.token_at[node]
                ok = np.flatnonzero((token >= 0) & (self.arcs[token, here >> 3] >> (here & 7) & 1).astype(bool))
                state[depth, row[ok]] = self.target[token[ok]]
                via[depth, row[ok]] = token[ok]
                more = sizes[row] > depth
                row, node, here = row[more], node[more], here[more]
        left, steps, index = sizes.copy(), [], np.arange(rows)
        while (left > 0).any():
            token = np.where(left > 0, via[left, index], -1)
            if ((token < 0) & (left > 0)).any():
                raise ValueError("no arc sequence spells a word")
            steps.append(token)
            left = np.where(token >= 0, left - self.lengths[token], 0)
        if not steps:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        back = np.stack(steps[::-1], 1)
        return back[back >= 0], (back >= 0).sum(1)


    def _encode_one(self, word: bytes, last_marked: bool) -> list[int]:
        if not hasattr(self, "_steps"):
            self._steps = self.base.tolist(), self.check.tolist(), self.token_at.tolist(), self.target.tolist()
        base, check, token_at, target = self._steps
        symbols, n, arcs = list(word), len(word), self.arcs
        if last_marked and n:
            symbols[-1] += 256
        state, via = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            node, depth, here = 0, i, state[i]
            while depth < n:
                child = base[node] + symbols[depth]
                if depth > i and check[child] != node:
                    break
                node, depth = child, depth + 1
                token = token_at[node]
                if token >= 0 and arcs[token, here >> 3] >> (here & 7) & 1:
                    state[depth], via[depth] = target[token], token
        out = []
        while n:
            out.append(via[n])
            n -= int(self.lengths[via[n]])
        return out[::-1]


class Tokenizer:
    """What a tokenizer file says: normalisation, pre-splitting, merges, added tokens and decoding.

    Read from the JSON form of the tokenizers library, for byte-level BPE with
    normalisers NFC, Replace and Lowercase and with a Split or byte-level
    pre-tokeniser; anything else raises. Truncation and padding are not used.
    """

    #: Fixed value: the split that a byte-level pre-tokeniser with use_regex applies.
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    CACHE = 400_000

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.key = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or self.suffix not in ("", END) or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only byte-level BPE, with or without word ends, is supported")
        self.steps = []
        normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        for n in normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]:
            if n["type"] == "NFC":
                self.steps.append(("nfc", None, None))
            elif n["type"] == "Lowercase":
                self.steps.append(("lower", None, None))
            elif n["type"] == "Replace":
                pattern = n["pattern"].get("Regex") or regex.escape(n["pattern"]["String"])
                kind = "spaces" if pattern == r"\s+" and n["content"] == " " else "replace"
                self.steps.append((kind, regex.compile(_spaces(pattern)), n["content"]))
            else:
                raise ValueError(f"normaliser {n['type']} is not supported")
        pre = spec["pre_tokenizer"]
        pattern = None
        for p in pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]:
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
                pattern = p["pattern"]["Regex"]
            elif p["type"] == "ByteLevel" and not p["add_prefix_space"]:
                pattern = self.BYTE_LEVEL if p["use_regex"] else pattern
            else:
                raise ValueError(f"pre-tokeniser {p['type']} is not supported")
        self.split = regex.compile(_spaces(pattern))
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        symbols = [*letters, *(c + self.suffix for c in letters)] if self.suffix else letters
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(symbols, merges)
        vocab = model["vocab"]
        self.ids = np.array([vocab[x] for x in self.automaton.labels], np.uint32)
        self.label_of = {i: x for x, i in vocab.items()} | {i: x for x, i in self.added.items()}
        self.byte_of = {c: b for b, c in enumerate(letters)}

    def normalise(self, text: str) -> str:
        for kind, pattern, new in self.steps:
            if kind == "nfc":
                text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
            elif kind == "spaces":  # one line break is one space; only what then still needs it is searched through
                text = text.replace("\n", " ")
                text = pattern.sub(" ", text) if "  " in text or _ODD_SPACE.search(text) else text
            elif kind == "replace":
                text = pattern.sub(new, text)
            else:  # letter by letter, so that a final sigma is like any other
                text = text.replace("\u03a3", "\u03c3").lower()
                text = text if text.isascii() else text.translate(_NEWER_CASES)
        return text

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Pre-split words of a text and which added token, if any, stands between runs of them: a list of runs' words with added tokens in place."""
        if self.added_split is None or not any(a in text for a in self.added):
            return self.split.findall(self.normalise(text)), []
        out: list[str] = []
        seen = []
        for i, part in enumerate(self.added_split.split(text)):
            if i % 2:
                out.append("\0" + part)  # marked: no pre-split word has a NUL before an added token
                seen.append("\0" + part)
            else:
                out.extend(self.split.findall(self.normalise(part)))
        return out, seen

    def learn(self, words: Iterable[str], cache: dict[str, tuple[bytes, str]]) -> None:
        """Encode the words and put their ids (little-endian 32 bits) and labels, joined by spaces, into ``cache``."""
        words = list(words)
        tokens, offsets = self.automaton.encode([w.encode("utf-8", "surrogatepass") for w in words], bool(self.suffix))
        data, cuts = self.ids[tokens].astype("<u4").tobytes(), (4 * offsets).tolist()
        labels, at = [self.automaton.labels[t] for t in tokens.tolist()], offsets.tolist()
        for i, w in enumerate(words):
            cache[w] = data[cuts[i] : cuts[i + 1]], " ".join(labels[at[i] : at[i + 1]])

    def decode_labels(self, joined: str) -> str:
        """The text that a decoder makes of arc labels joined by spaces: the labels themselves, or for byte-level decoders their bytes."""
        if not self.byte_decoder:
            return joined
        out = bytearray()
        for label in joined.split(" ") if joined else []:
            out += label.encode() if label in self.added else bytes(self.byte_of[c] for c in label)
        return out.decode("utf-8", "replace")

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """``(ids as little-endian 32-bit integers, decoded text)`` of each text; null counts as empty."""
        cache = _WORDS.setdefault(self.key, {})
        if len(cache) > self.CACHE:
            cache.clear()
        out = []
        at = 0
        while at < len(texts):  # blocks bound what is held: about 4 million characters, or one text
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= 4_000_000):
                size += len(texts[end] or "")
                end += 1
            split = [self.words(t) if t else ([], []) for t in texts[at:end]]
            special = {w for _, s in split for w in s}
            new = set().union(*(w for w, _ in split)).difference(cache, special)
            self.learn(new, cache)
            for w in special:
                cache[w] = int(self.added[w[1:]]).to_bytes(4, "little"), w[1:]
            for words, _ in split:
                got = [cache[w] for w in words]
                out.append((b"".join([g[0] for g in got]), self.decode_labels(" ".join([g[1] for g in got]))))
            if len(cache) > self.CACHE:
                cache.clear()
            at = end
        return out


def _spaces(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, which the regex module's own class exceeds by U+001C to U+001F."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


_ODD_SPACE = regex.compile(r"[^\P{White_Space} ]")
_WORDS: dict[str, dict[str, tuple[bytes, str]]] = {}
_COMPILED: dict[str, Tokenizer] = {}


def compile_tokenizer(path: str) -> Tokenizer:
    """The tokenizer in a file that the driver can read; compiled once per process."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    key = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Tokenizer(text)
    return _COMPILED[key]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text, and with ``full`` the ids and the decoded text.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows
    and null keys pass through; other columns are not read. The compiled
    tables, whose size the vocabulary fixes, are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if full:
        schema = schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        for b in batches:
            got = held.value.encode_batch(b.column(1).to_pylist())
            columns = [
                b.column(0),
                pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in got], pa.string()),
            ]
            if full:
                columns += [pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)
