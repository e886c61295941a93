"""Byte-pair encoding and decoding as streaming state machines over a public vocabulary file.

The encoder is a transducer with bounded lookahead. Text comes in pieces and is
cut into words by the vocabulary file's own rules; a word is fed symbol by
symbol. After each symbol the transducer knows, for every recent position, the
last token of the encoding of the symbols so far: the one token that ends there,
starts where another such encoding ends, and stands next to that encoding's last
token as the merge list would leave it. No later token can reach back further
than the longest token of the merge list, so that length is the sufficient
lookahead: once all positions within it descend from one earlier position,
everything before that position is stable and is emitted. The transducer's
memory holds that window only; the encoder's, a piece and the longest run without
white space.

A bounded cache keeps what the transducer gave for chunks and words of usual
length. The decoder turns ids into bytes and bytes into text through an
incremental UTF-8 state machine, block by block as ids come.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Cache, held, table

CACHE_ENTRIES = 800_000
CACHED_CHARS = 48
#: A text is encoded in pieces of so many characters.
PIECE_CHARS = 1 << 16


def default_vocabulary() -> str:
    """Where the public vocabulary file is on this machine; executors look for themselves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by rule: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Merges:
    """Vocabulary and merge ranks of a file, and what follows from them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.joined = [a + b for a, b in pairs]
        self.raw = {token: i.to_bytes(4, "little") for token, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        #: Symbols of the longest token: no token of a later position starts further back.
        self.lookahead = max(self.length(s) for s in self.ids)
        self._next_to: dict[tuple[str, str], bool] = {}
        #: The ends of all tokens: what isn't among them ends no token.
        self.tails = {s[i:] if self.suffix == "" or not s.endswith(self.suffix) or s == self.suffix else s[i : -len(self.suffix)] + self.suffix for s in self.ids for i in range(self.length(s))}

    def length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix and token != self.suffix else len(token)

    def split(self, token: str) -> list[str]:
        """The symbols of a token; the end-of-word mark belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            plain = token[: -len(self.suffix)]
            return [*plain[:-1], plain[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """The merge list applied to symbols in full: lowest rank first, leftmost first."""
        rank, never, joined = self.ranks.get, len(self.ranks), self.joined
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            parts[at : at + 2] = (joined[best],)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the merge list leaves these two tokens next to each other."""
        key = (left, right)
        known = self._next_to.get(key)
        if known is None:
            if len(self._next_to) > CACHE_ENTRIES:
                self._next_to.clear()
            known = self._next_to[key] = self.merge([*self.split(left), *self.split(right)]) == [left, right]
        return known


class Transducer:
    """Feeds symbols of one word; emits tokens as soon as no later symbol can change them."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.window: list[str] = []  # symbols since the last stable position
        self.last: list[tuple[int, str]] = [(-1, "")]  # for each position from it: where the last token starts, the token
        self.most = 0  # the longest window so far

    def feed(self, symbols: Iterable[str]) -> Iterator[str]:
        """Take symbols one after the other; give the tokens that have become stable."""
        m, window = self.merges, self.window
        ids, tails, known, reach = m.ids, m.tails, m._next_to, m.lookahead
        for symbol in symbols:
            window.append(symbol)
            last, n = self.last, len(window)
            start, token, found = n - 1, symbol, None
            lowest = max(0, n - reach)
            while True:
                if token in ids:
                    before = last[start]
                    if before is not None:
                        left = before[1]
                        beside = True if left == "" else known.get((left, token))
                        if beside or (beside is None and m.adjacent(left, token)):
                            found = (start, token)
                            break
                start -= 1
                if start < lowest:
                    break
                token = window[start] + token
                if token not in tails:
                    break
            last.append(found)
            if n > self.most:
                self.most = n
            if n % reach == 0:
                yield from self._settle()

    def _settle(self) -> Iterator[str]:
        """Emit what every position that a later token may start from has in common."""
        n, reach = len(self.window), self.merges.lookahead
        chains = {i for i in range(max(0, n - reach), n + 1) if self.last[i] is not None}
        while len(chains) > 1:
            top = max(chains)
            chains.remove(top)
            chains.add(self.last[top][0] if top else 0)
            if 0 in chains and len(chains) > 1 and max(chains) == 0:
                break
        stable = chains.pop()
        if stable <= 0:
            return
        yield from self._tokens(stable)
        kept = self.last[stable][1]
        del self.window[:stable]
        self.last = [(-1, kept)] + [None if x is None else (x[0] - stable, x[1]) if x[0] >= stable else None for x in self.last[stable + 1 :]]

    def _tokens(self, stop: int) -> list[str]:
        out = []
        while stop > 0:
            start, token = self.last[stop]
            out.append(token)
            stop = start
        return out[::-1]

    def end(self) -> list[str]:
        return self._tokens(len(self.window))


class Encoder(Cache):
    """Maps a chunk without white space to the bytes of its ids, little-endian and unsigned, four to an id.

    A bounded cache keeps chunks and words of usual length. What it lacks is encoded by the transducer,
    or, if `whole`, by merging each word as a whole, which takes less time where ids are not the result.
    """

    def __init__(self, path: str, whole: bool = False) -> None:
        import regex

        super().__init__(CACHE_ENTRIES)
        self.merges = Merges(path)
        specials = "|".join(re.escape(s) for s in sorted(self.merges.special, key=len, reverse=True))
        self._special = re.compile(f"({specials})") if specials else None
        # The vocabulary file's rules for words and for white space.
        self._word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._odd_space = re.compile("[\x1c-\x1f]")
        self.whole = whole
        self.fed = 0  # words that went through the transducer
        self._chunk = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self._space = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __missing__(self, chunk: str) -> bytes:
        known = self.older.get(chunk)
        if known is not None:
            self.keep(chunk, known)
            return known
        parts = self._special.split(chunk) if self._special and "<|" in chunk else [chunk]
        out = bytearray()
        for i, part in enumerate(parts):
            if i % 2:
                out += self.merges.special[part].to_bytes(4, "little")
            elif part:
                folded = self.folded(part)
                if folded.isalpha():
                    out += self.word(folded)
                elif folded[-1] in ",." and folded[:-1].isalpha():
                    out += self.word(folded[:-1]) + self.word(folded[-1])
                else:
                    for word in self._word.findall(folded):
                        out += self.word(word)
        out = bytes(out)
        if len(chunk) <= CACHED_CHARS:
            self.keep(chunk, out)
        return out

    @staticmethod
    def folded(text: str) -> str:
        """Composed, and lower case by single characters: a capital sigma has one lower case wherever it stands."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word(self, word: str) -> bytes:
        """The ids of a word; it is also the chunk that holds nothing else."""
        known = self.get(word) or self.older.get(word)
        if known is None:
            known = b"".join(map(self.merges.raw.__getitem__, self.tokens(word)))
            if len(word) <= CACHED_CHARS:
                self.keep(word, known)
        return known

    def tokens(self, word: str) -> list[str]:
        m = self.merges
        symbols = [m.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += m.suffix
        if self.whole:
            return m.merge(symbols)
        self.fed += 1
        machine = Transducer(m)
        return [*machine.feed(symbols), *machine.end()]

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes to an id."""
        chunks = self._chunk.findall(text) if self._odd_space.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))

    def encode_stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """The same for a text that comes in pieces; holds back the chunk that the next piece may go on with."""
        held = ""
        for piece in pieces:
            cut = len(held)
            while cut and not self._space.match(held[cut - 1]):
                cut -= 1
            if cut:
                yield self.encode(held[:cut])
            held = held[cut:] + piece
        if held:
            yield self.encode(held)


def pieces_of(text: str, size: int | None = None) -> Iterator[str]:
    """A text in pieces of PIECE_CHARS."""
    size = size or PIECE_CHARS
    for at in range(0, len(text), size):
        yield text[at : at + size]


class Decoder:
    """Ids to text, token by token."""

    def __init__(self, path: str) -> None:
        merges = Merges(path)
        self.suffix = merges.suffix
        self.size = max(merges.names) + 1
        byte_of = {s: b for b, s in enumerate(merges.symbols)}
        self.names = [merges.names.get(i, "").encode("utf-8") for i in range(self.size)]
        self.plain = []
        for i in range(self.size):
            name = merges.names.get(i, "")
            if name in merges.special:
                self.plain.append(name.encode("utf-8"))
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix)
            self.plain.append(bytes(byte_of[c] for c in (name[: -len(self.suffix)] if ends else name)) + (b" " if ends else b""))

    def named(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Text as a vocabulary file without a decoder stands for: the names of tokens with spaces between them, a piece for each block of ids.

        The machine's state is whether a token came before, and the bytes of a character that isn't whole yet.
        """
        machine, names, first = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.names, True
        for ids in blocks:
            if ids:
                raw = b" ".join(map(names.__getitem__, ids))
                yield machine.decode(raw if first else b" " + raw)
                first = False
        yield machine.decode(b"", True)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as soon as their bytes are whole; broken bytes become the replacement character."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            if piece := machine.decode(self.plain[i]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece

    def text(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids)).removesuffix(" ")


def each_batch(path: str | None, make, schema):
    """A function for mapInArrow that builds its coders once in each worker process."""

    def run(batches):
        import pyarrow as pa

        vocabulary = path or default_vocabulary()
        state = make(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(state(batch), schema=schema())

    return run


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (binary) and decoded.

    NULL text is empty and has no tokens. Rows are independent, so repeated
    rows and NULL ids just pass; other columns are ignored; an empty table
    gives an empty result. Texts of any length are encoded whole.
    """

    def schema():
        import pyarrow as pa

        own = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        return pa.schema(own + ([("ids", pa.binary()), ("decoded", pa.string())] if keep_ids else []))

    def make(path):
        import numpy as np

        encoder, decoder = held(("encoder", path), lambda: Encoder(path)), held(("decoder", path), lambda: Decoder(path))

        def one(batch):
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
            for text in batch.column(1):
                of_ids, of_text, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []

                def blocks(text=text.as_py() or ""):
                    nonlocal count
                    for raw in encoder.encode_stream(pieces_of(text)):
                        of_ids.update(raw)
                        count += len(raw) // 4
                        if keep_ids:
                            kept.append(raw)
                        yield np.frombuffer(raw, "<u4").tolist()

                for piece in decoder.named(blocks()):
                    of_text.update(piece.encode("utf-8"))
                out["n_tokens"].append(count)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(of_text.hexdigest())
                if keep_ids:
                    ids = b"".join(kept)
                    out["ids"].append(ids)
                    out["decoded"].append(decoder.text(np.frombuffer(ids, "<u4").tolist()))
            return out

        return one

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(each_batch(vocabulary, make, schema), ddl)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return encode_decode(table(spark, sf_dir, "documents"))
