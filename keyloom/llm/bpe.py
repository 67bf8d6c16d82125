"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It accepts a sequence of tokens exactly when BPE gives that sequence for the bytes it spells.
It starts as one state that every byte leads back to, and each merge (u, v) in turn applies a gadget:

* the state that u leads to becomes one of its own, without its arc v: u and v never stay side by side again;
* the new token uv gets an arc from every state that has an arc u, to what v led to before;
* if u and v are the same token, the state after u gets no such arc: of three in a row the first two merge.

As all arcs of one token lead to the same state, states are named by tokens. A state after uv is thus a copy, made at that
merge, of the state after v, less the arcs removed and plus the arcs added since. Only these differences are stored: the
merge at which each token was born, and the merge at which an arc was removed. Looking an arc up follows the copies back,
and what it finds is filled into a transition table: the whole table has a bit for each pair of 50,000 tokens, of which words
in use ask for some 100,000.

Bytes drive it through a second table, that of an automaton which knows all labels of arcs: from the longest label's
beginning that ends at a place, one byte leads to that at the next place. Each place's arc is the one whose label ends
there and that leaves the state reached where the label begins. There is one at most, and each byte is read once.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import give_back, table

# The letters and numbers of Unicode 17 that the tokenizers library, at Unicode 16, does not know as such.
UNKNOWN = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_LETTER, _NUMBER = rf"[\p{{L}}--[{UNKNOWN}]]", rf"[\p{{N}}--[{UNKNOWN}]]"
#: Byte-level BPE's own splitting rule: contractions, then letters, numbers or other characters after at most one space.
SPLIT = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:[^\s\p{{L}}\p{{N}}]|[{UNKNOWN}])+|\s+(?!\S)|\s+")
DOUBLE = re.compile(r"\s\s")
END = frozenset(".,;:!?")
#: Words of so many texts are remembered at most; encoding is the same with or without.
REMEMBERED = 300_000
#: Longer texts are split a piece at a time, and output batches are closed at about this size.
PIECE, BATCH_BYTES = 1_000_000, 8_000_000


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Automaton:
    """The compiled automaton of a tokenizer file (byte-level BPE in the tokenizers library's JSON)."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        letters, vocab = byte_of(), spec["model"]["vocab"]
        spelled = lambda token: bytes(letters[c] for c in token)
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))], default=0))
        for token, i in vocab.items():
            self.labels[i] = spelled(token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.labels[i] = content.encode()
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        n = len(self.labels)
        self.size, self.born = n, [0] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.removed: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.arcs: dict[bytes, int] = {bytes([b]): vocab[c] for c, b in letters.items() if c in vocab}
        for when, pair in enumerate(spec["model"]["merges"], 1):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._merge(vocab[u], vocab[v], vocab[u + v], when)
        self.lengths = [len(label) for label in self.labels]
        self._compile_bytes()

    def _compile_bytes(self) -> None:
        """The tree of the labels, node * 256 + byte to node, and for each node: the node of its longest proper end that is in
        the tree, and the longest label that ends its path. shorter: the next label that ends a label."""
        tree = self.next = {}
        parent, byte, label_of = array("i", [0]), bytearray(1), array("i", [-1])
        for label, token in self.arcs.items():
            node = 0
            for b in label:
                below = tree.get(node << 8 | b)
                if below is None:
                    below = tree[node << 8 | b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    label_of.append(-1)
                node = below
            label_of[node] = token
        depth = array("i", [0]) * len(parent)
        for node in range(1, len(parent)):  # parents come before their children
            depth[node] = depth[parent[node]] + 1
        fall = self.fall = array("i", [0]) * len(parent)
        longest = self.longest = array("i", [-1]) * len(parent)
        self.shorter = array("i", [-1]) * self.size
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[node] > 1:
                end = fall[parent[node]]
                while (below := tree.get(end << 8 | byte[node])) is None and end:
                    end = fall[end]
                fall[node] = below or 0
            token = label_of[node]
            longest[node] = token if token >= 0 else longest[fall[node]]
            if token >= 0:
                self.shorter[token] = longest[fall[node]]
        self.own = len(tree)

    def _step(self, node: int, byte: int) -> int:
        """The transition that the table lacks, filled in."""
        key, at = node << 8 | byte, node
        while (below := self.next.get(at << 8 | byte)) is None and at:
            at = self.fall[at]
        if len(self.next) - self.own < REMEMBERED:
            self.next[key] = below or 0
        return below or 0

    def _merge(self, u: int, v: int, uv: int, when: int) -> None:
        """The gadget of one merge."""
        if self.has_arc(u, v, when):
            self.born[uv], self.left[uv], self.right[uv] = when, u, v
            self.arcs[self.labels[uv]] = uv
            self.removed[u * self.size + v] = when

    def has_arc(self, state: int, token: int, when: int) -> bool:
        """Whether the state after one token had an arc for another just before the merge numbered when."""
        born = self.born
        while True:
            removed = self.removed.get(state * self.size + token)
            if removed is not None and removed < when:
                return False
            made, added = born[state], born[token]
            if not made and not added:
                return True
            if made > added:  # the state is a copy, made then, of the one after its right half
                state, when = self.right[state], made
            elif made == added:  # the token after itself: as its left half after its right half
                state, token, when = self.right[state], self.left[token], added
            else:  # the arc came then to the states that had one for its left half
                if state == self.left[token] == self.right[token]:
                    return False
                token, when = self.left[token], added

    def path(self, word: bytes) -> list[int]:
        """The one accepted path that spells word; each byte is one transition, and none is read again."""
        if word in self.arcs:  # the first state has an arc for every token, and no other path spells it
            return [self.arcs[word]]
        size, table_, next_, longest, shorter, lengths = self.size, self.table, self.next, self.longest, self.shorter, self.lengths
        node, states = 0, [-1]  # by place: the token whose arc leads there
        for end, byte in enumerate(word, 1):
            below = next_.get(node << 8 | byte)
            node = self._step(node, byte) if below is None else below
            token = longest[node]
            while token >= 0:
                state = states[end - lengths[token]]
                if state < 0:  # the first state, or a place that no path reaches
                    if end == lengths[token]:
                        break
                else:
                    key = state * size + token
                    ok = table_.get(key)
                    if ok is None:
                        ok = table_[key] = self.has_arc(state, token, 1 << 60)
                    if ok:
                        break
                token = shorter[token]
            states.append(token)
        if states[-1] < 0 and word:
            raise ValueError("the vocabulary cannot spell this word")
        tokens, end = [], len(word)
        while end:
            tokens.append(states[end])
            end -= lengths[states[end]]
        return tokens[::-1]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, put together; what is no UTF-8 becomes U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


class Words(dict):
    """Packed ids by word, made by make when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if 2 * len(self) >= REMEMBERED:  # words that are met again come back from the generation before
            self.before = dict(self)
            self.clear()
        out = self.before.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.words = Words(self._word)
        self.after_space = Words(self._after_space)

    def forget(self) -> None:
        """Let go of the words and arcs met so far."""
        self.words, self.after_space = Words(self._word), Words(self._after_space)
        self.automaton.table.clear()

    def _word(self, word: str) -> bytes:
        if len(self.automaton.table) >= 2 * REMEMBERED:
            self.automaton.table.clear()
        ids = array("I", self.automaton.path(word.encode("utf-8", "replace")))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _after_space(self, unit: str) -> bytes:
        """Of a space and what follows it up to the next white space."""
        if unit.isalpha():
            return self._word(" " + unit)
        if unit[-1:] in END and unit[:-1].isalpha():
            return self.words[" " + unit[:-1]] + self.words[unit[-1]]
        return self._split(" " + unit)

    def _split(self, text: str) -> bytes:
        if len(text) <= PIECE:
            return b"".join(map(self.words.__getitem__, SPLIT.findall(text)))
        found, parts = (m.group() for m in SPLIT.finditer(text)), []
        while part := b"".join(map(self.words.__getitem__, islice(found, 100_000))):
            parts.append(part)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        special, apart = self.automaton.special, self.automaton.apart
        if apart is not None and any(s in text for s in special):
            return b"".join([special[p].to_bytes(4, "little") if p in special else self._plain(p) for p in apart.split(text) if p])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """Where white space stands alone, words end before each space and on both sides of each line break.

        So the parts between them can be looked up whole; other texts are split by the full rule.
        """
        if DOUBLE.search(text) is not None:
            return self._split(text)
        out, words, after = [], self.words, self.after_space
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(words["\n"])
            units = line.split(" ")
            if units[0]:
                out.append(self._split(units[0]))
            out += map(after.__getitem__, units[1:])
        return b"".join(out)


_by_digest: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The compiled tokenizer of a broadcast definition, one for each worker."""
    digest, definition = shared.value
    if digest not in _by_digest:
        _by_digest.clear()
        _by_digest[digest] = Encoder(Automaton(definition))
    return _by_digest[digest]


def tokenizer(spark: SparkSession, path: str):
    """The tokenizer file at path, read by the driver and broadcast (a vocabulary file, whatever the number of texts)."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(definition.encode()).hexdigest(), definition))


IDS, TEXT = (T.BinaryType(), pa.binary()), (T.StringType(), pa.string())


def _mapped(df: DataFrame, column: str, new: dict[str, tuple[T.DataType, pa.DataType]], make, drop: bool = False) -> DataFrame:
    """df with the columns new = make()(value of column), in batches of bounded size; without column itself if drop."""
    clash = set(new) & set(df.columns)
    if clash:
        raise ValueError(f"{sorted(clash)} are columns already")
    names = df.columns
    kept = [n for n in names if not (drop and n == column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            begin, size, out = 0, 0, []
            values = batch.column(names.index(column))
            for i in range(batch.num_rows):
                out.append(f(values[i].as_py()))
                size += sum(map(len, out[-1]))
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    arrays = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), new.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[part.column(names.index(n)) for n in kept], *arrays], [*[f"c{i}" for i in range(len(kept))], *[f"n{i}" for i in range(len(new))]])
                    begin, size, out = i + 1, 0, []
        for encoder in _by_digest.values():
            encoder.forget()
        give_back()

    # Spark takes the columns by name there, and some names cannot be said
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [*[T.StructField(f"c{i}", df.schema[n].dataType) for i, n in enumerate(kept)], *[T.StructField(f"n{i}", kind) for i, (kind, _) in enumerate(new.values())]]
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*kept, *new)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col: the ids of each whole text, binary, as little-endian unsigned 32-bit integers.

    Exactly the ids that the tokenizers library gives for the file at path without adding special tokens; a special
    token's own string in a text becomes that token. Null and empty texts have no ids. Rows are handled one by one: ties,
    repeated rows and other columns change nothing; ids_col must be a new name.
    """
    shared = tokenizer(docs.sparkSession, path)

    def make():
        encoder = _encoder(shared)
        return lambda text: (encoder.encode(text or ""),)

    return _mapped(docs, text_col, {ids_col: IDS}, make)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with text_col: the text that the ids spell; null ids give the empty text."""
    shared = tokenizer(encoded.sparkSession, path)

    def make():
        automaton = _encoder(shared).automaton
        return lambda ids: (automaton.decode(ids or b""),)

    return _mapped(encoded, ids_col, {text_col: TEXT}, make)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """encode, then decode of the ids it gave, in one pass through one worker."""
    shared = tokenizer(docs.sparkSession, path)

    def make():
        encoder = _encoder(shared)

        def both(text: str | None) -> tuple[bytes, str]:
            ids = encoder.encode(text or "")
            return ids, encoder.automaton.decode(ids)

        return both

    return _mapped(docs, text_col, {ids_col: IDS, decoded_col: TEXT}, make, drop=not keep_text)


def ids_array(ids) -> F.Column:
    """Binary ids as an array of ints."""
    pair = lambda i, k: F.substring(F.hex(F.substring(ids, i * 4 + 1, F.lit(4))), F.lit(2 * k + 1), F.lit(2))
    at = lambda i: F.conv(F.concat(*[pair(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("int")
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int")), at)).otherwise(F.array().cast("array<int>"))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), keep_text=False).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
