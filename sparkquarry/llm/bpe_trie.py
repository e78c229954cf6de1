"""BPE encoding by a depth-first walk of a trie of distinct words, and decoding.

A word's encoding under byte-pair merges has the prefix property: if t is the last token of the encoding of a prefix p,
the encoding of p is that of p without t, then t. And t is the one vocabulary suffix of p that stays apart from the last
token before it. So each trie node needs only the last token of its prefix, found from the states on the path above;
prefixes that words share are worked out once.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, memory_returned, small_batches, text_or_empty

#: Entries that one Python worker keeps: chunks between white space, some 400 bytes each, pre-tokens by chunk; and token pairs.
CHUNKS, WORDS, PAIRS = 250_000, 0.64, 200_000
#: Bytes of a chunk or pre-token that is kept after its texts are done.
LONG = 200
#: Bytes of text whose new words make one trie; a text is not cut.
TRIE_BYTES = 1_000_000

#: Rank of merges that never happen.
NEVER = 1 << 60


class TrieBpe:
    """Last-token states over symbols: characters of a pre-token in the vocabulary's alphabet, the last one with its word end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        cut = len(end)
        self.final = {t[:-cut]: i for t, i in vocab.items() if t.endswith(end) and len(t) > cut} if end else {}
        self.inner = {t: i for t, i in vocab.items() if not (end and t.endswith(end) and len(t) > cut)}
        self._automaton()
        self.strings = {i: t for t, i in vocab.items()}
        self.apart: dict[int, bool] = {}  # by the first token's id << 20 | the second's
        self.pairs = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], i) for i, (a, b) in reversed([*enumerate(merges)])}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        if any(self.parts.get(x, (0, 0, -1))[2] >= rank for a, b, rank in self.parts.values() for x in (a, b)):
            raise ValueError("a merge comes before the merges of its parts")

    def _automaton(self) -> None:
        """States are the prefixes of tokens, an ended token's without its last symbol; failures lead to the longest proper suffix."""
        self.prefixes, self.moves = [""], [{}]
        for token, cut in [*((t, len(t)) for t in self.inner), *((t, len(t) - 1) for t in self.final)]:
            state = 0
            for i, char in enumerate(token[:cut]):
                to = self.moves[state].get(char)
                if to is None:
                    to = self.moves[state][char] = len(self.prefixes)
                    self.prefixes.append(token[: i + 1])
                    self.moves.append({})
                state = to
        place = {p: i for i, p in enumerate(self.prefixes)}
        self.fail = [next(place[p[i:]] for i in range(1, len(p) + 1) if p[i:] in place) if p else 0 for p in self.prefixes]
        self.inner_ends: list[list[tuple[int, int]] | None] = [None] * len(self.prefixes)
        self.endings: dict[tuple[int, str], list[tuple[int, int]]] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """The plain merges, lowest rank first, leftmost of equals."""
        vocab, out = self.vocab, list(symbols)
        rank = lambda a, b: self.pairs.get((vocab.get(a), vocab.get(b)), NEVER)
        while len(out) > 1:
            best, at = min((rank(a, b), i) for i, (a, b) in enumerate(zip(out, out[1:])))
            if best == NEVER:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens at the right (left) edge of a token while it is merged, each with the rank of the merge that ends it."""
        known = self.spines.get((token, right))
        if known is None:
            known, later = [], NEVER
            while True:
                known.append((token, later))
                if token not in self.parts:
                    break
                a, b, later = self.parts[token]
                token = b if right else a
            known.reverse()
            self.spines[known[-1][0], right] = known
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the symbols of two adjacent tokens merge into just these two tokens.

        Parts have lower ranks than what they form, so the edges on either side of the boundary change in order of rank;
        a merge across it happens if its rank comes up first. Of equal ranks the leftmost is first.
        """
        known = self.apart.get(a << 20 | b)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            left, right, i, j = self.spine(a, True), self.spine(b, False), 0, 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.pairs.get((x, y), NEVER)
                if across < x_ends and across <= y_ends and across != NEVER:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.apart[a << 20 | b] = known
        return known

    def move(self, state: int, char: str) -> int:
        """The automaton's state after one more symbol: the longest suffix of the path that begins a vocabulary token."""
        to = self.moves[state].get(char)
        if to is None:
            # a failure state is shorter than its state, so this ends at the root
            to = self.moves[state][char] = self.move(self.fail[state], char) if state else 0
        return to

    def suffixes(self, state: int, table: dict[str, int], last: str = "") -> list[tuple[int, int]]:
        """(id, symbols) of the tokens of ``table`` that end the path at a state, or at ``last`` after it, longest first."""
        text, add = self.prefixes[state] + last, len(last)
        found = [(table[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in table]
        if not found and add and last in table:
            found = [(table[last], 1)]
        return found

    def ending(self, state: int, last: str) -> list[tuple[int, int]]:
        known = self.endings.get((state, last))
        if known is None:
            known = self.endings[state, last] = self.suffixes(state, self.final, last)
        return known

    def last_token(self, found: list[tuple[int, int]], d: int, ids: list[int]) -> tuple[int, int]:
        """(id, symbols) of the last token of a prefix of ``d`` symbols: of the tokens that end it, the one that stays apart
        from the last token of the prefix before it."""
        apart = self.apart
        for token, n in found:
            if n == d:
                return token, n
            before = ids[d - n]
            stays = apart.get(before << 20 | token)
            if stays or (stays is None and self.stay_apart(before, token)):
                return token, n
        raise KeyError(d)

    def encode_words(self, words) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct non-empty words.

        In sorted order words are the leaves of their trie depth first, so a word starts from the states that it shares
        with the one before, and only nodes that are new on the path get a state: the last token of their prefix, and
        where an automaton over the vocabulary is after it.
        """
        out: dict[str, tuple[int, ...]] = {}
        ids, lengths, states, before = [0], [0], [0], ""
        moves, move, inner, last_token, apart = self.moves, self.move, self.inner_ends, self.last_token, self.apart
        last = -1 if self.end else None
        for word in sorted(words):
            inside = word[:last]
            shared = 0
            for a, b in zip(before, inside):
                if a != b:
                    break
                shared += 1
            del ids[shared + 1 :], lengths[shared + 1 :], states[shared + 1 :]
            state, d = states[shared], shared
            for char in inside[shared:]:
                to = moves[state].get(char)
                state = move(state, char) if to is None else to
                d += 1
                found = inner[state]
                if found is None:
                    found = inner[state] = self.suffixes(state, self.inner)
                token, n = found[0]
                if n != d and not apart.get(ids[d - n] << 20 | token):
                    token, n = last_token(found, d, ids)
                ids.append(token)
                lengths.append(n)
                states.append(state)
            before, at, tokens = inside, d, []
            if self.end:
                token, n = last_token(self.ending(state, word[-1]), d + 1, ids)
                at, tokens = d + 1 - n, [token]
            while at > 0:
                tokens.append(ids[at])
                at -= lengths[at]
            tokens.reverse()
            out[word] = tuple(tokens)
        return out


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {b for b in range(256) if chr(b).isprintable() and b not in (32, 160)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Whole texts to (n, ids, tokens) through tables of chunks between ASCII white space and of pre-tokens."""

    #: Chunks of printable ASCII and composed Latin-1 letters, which normalisation only lower-cases character by character.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    #: PATTERN for such chunks in lower case, and the line feeds between them.
    PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")
    #: The pre-tokenizer's own pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, file: str, chunks: int = CHUNKS):
        from tokenizers import Tokenizer

        self.most_chunks, self.most_words = chunks, int(chunks * WORDS)
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = TrieBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        # only to normalise and pre-tokenise: without the vocabulary, which it would hold once more
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        parts = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]]
        if self.PATTERN not in parts or spec["decoder"] is not None or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("this encoder is for word-end BPE with the known pre-tokenizer, no decoder and verbatim added tokens")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max(*self.trie.strings, *self.added.values()) + 1
        self.numbers, self.names = [f"{i} " for i in range(size)], [""] * size
        for i, token in (self.trie.strings | {i: t for t, i in self.added.items()}).items():
            self.names[i] = token + " "
        #: Ids and tokens, each followed by a space, of chunks and of pre-tokens; a line feed stands for itself between chunks.
        self.chunk_ids: dict[bytes, str] = {}
        self.chunk_tokens: dict[bytes, str] = {}
        self.word_ids: dict[str, str] = {"\n": "\n"}
        self.word_tokens: dict[str, str] = {"\n": "\n"}
        self.alphabet = byte_alphabet()

    def pieces(self, chunk: bytes) -> list[str | int]:
        """Pre-tokens in the vocabulary's alphabet, and ids of added tokens, of a chunk."""
        text, out = chunk.decode(), []
        for part in self.split_added.split(text) if self.split_added else (text,):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)) if p]
        return out

    def spell(self, words: dict[str, str]) -> None:
        """Learn new words, given with their spelling in the alphabet."""
        numbers, names = self.numbers.__getitem__, self.names.__getitem__
        encoded = self.trie.encode_words(set(words.values()))
        for word, spelling in words.items():
            ids = encoded[spelling]
            self.word_ids[word] = "".join(map(numbers, ids))
            self.word_tokens[word] = "".join(map(names, ids))

    def learn(self, chunks: set[bytes]) -> None:
        plain, texts, other = [], [], {}
        match, added = self.PLAIN.fullmatch, bool(self.added)
        for chunk in chunks:
            text = chunk.decode()
            if match(text) and not (added and "<|" in text):
                plain.append(chunk)
                texts.append(text)
            else:
                other[chunk] = self.pieces(chunk)
        if plain:  # all at once: line feeds part the chunks before and after
            flat = self.PLAIN_WORDS.findall("\n".join(texts).lower())
            self.spell({w: w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in set(flat).difference(self.word_ids)})
            self.chunk_ids.update(zip(plain, "".join(map(self.word_ids.__getitem__, flat)).split("\n")))
            self.chunk_tokens.update(zip(plain, "".join(map(self.word_tokens.__getitem__, flat)).split("\n")))
        # spelled pre-tokens are kept under a mark, as a plain word of the same letters is spelled otherwise
        self.spell({"\n" + p: p for p in {p for ps in other.values() for p in ps if p.__class__ is str} if "\n" + p not in self.word_ids})
        for chunk, ps in other.items():
            self.chunk_ids[chunk] = "".join([self.numbers[p] if p.__class__ is int else self.word_ids["\n" + p] for p in ps])
            self.chunk_tokens[chunk] = "".join([self.names[p] if p.__class__ is int else self.word_tokens["\n" + p] for p in ps])
        if len(self.word_ids) > self.most_words:
            self.forget_words()

    def forget_words(self) -> None:
        for table in (self.word_ids, self.word_tokens):
            table.clear()
            table["\n"] = "\n"

    def forget(self) -> None:
        """Empty the tables; what comes from the vocabulary stays."""
        self.forget_words()
        self.chunk_ids.clear()
        self.chunk_tokens.clear()
        self.trie.apart.clear()

    def know(self, chunks: set[bytes]) -> None:
        """Put the chunks into the table; when it is full, only those of them that it has stay."""
        new = chunks.difference(self.chunk_ids)
        if len(self.chunk_ids) + len(new) > self.most_chunks:
            kept = chunks.difference(new)
            self.chunk_ids, self.chunk_tokens = ({c: table[c] for c in kept} for table in (self.chunk_ids, self.chunk_tokens))
        if new:
            self.learn(new)

    def encode_split(self, texts: list[list[bytes]]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by a space, and tokens joined by a space, which is what decoding without a decoder
        gives, of texts as chunks. The new chunks of all texts make one trie, or of as many as fit in the table."""
        out, at = [], 0
        while at < len(texts):
            wanted, upto = set(texts[at][: self.most_chunks]), at + 1
            while upto < len(texts) and len(wanted) + len(texts[upto]) < self.most_chunks:
                wanted.update(texts[upto])
                upto += 1
            self.know(wanted)
            out += map(self.encode_chunks, texts[at:upto])
            long = [c for c in wanted if len(c) > LONG]
            for chunk in long:
                self.chunk_ids.pop(chunk, None)
                self.chunk_tokens.pop(chunk, None)
            if long:
                for word in [w for w in self.word_ids if len(w) > LONG]:
                    del self.word_ids[word], self.word_tokens[word]
            at = upto
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[int, str, str]:
        ids, tokens = [], []
        for at in range(0, len(chunks), self.most_chunks):  # in steps, so that the chunks of any text fit in the table
            part = chunks[at : at + self.most_chunks]
            if at:
                self.know(set(part))
            ids.append("".join(map(self.chunk_ids.__getitem__, part)))
            tokens.append("".join(map(self.chunk_tokens.__getitem__, part)))
        ids, tokens = "".join(ids), "".join(tokens)
        return ids.count(" "), ids[:-1], tokens[:-1]

    def encode(self, text: bytes) -> tuple[int, str, str]:
        return self.encode_split([text.split()])[0]


def encoder_of(file: str, chunks: int = CHUNKS) -> TextEncoder:
    return held(("bpe", file, chunks), lambda: TextEncoder(file, chunks))


def _encoded(docs: DataFrame, file: str, id_col: str, text_col: str, schema: str, columns, chunks: int) -> DataFrame:
    """A row a row of docs: its id, and the columns that ``columns`` makes of encoded texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = encoder_of(file, chunks)
        for number, batch in enumerate(batches, 1):
            texts, at = batch.column(1), 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (size < TRIE_BYTES or not part):
                    text = texts[at + len(part)].as_py().encode()
                    size += len(text)
                    part.append(text.split())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns(encoder.encode_split(part))], names=names)
                at += len(part)
            if number % 8 == 0:
                memory_returned()
        encoder.forget()
        memory_returned()

    names = ["id", *(c.split()[0] for c in schema.split(", "))]
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row: decimal ids joined by a space, and their decoding.

    Whole texts, without begin, end or added special tokens; special strings inside a text become their ids, as the
    library does. Null or empty text has no tokens and decodes to the empty text. Repeated rows and null ids give a row
    each, an empty table none; other columns are ignored. One narrow pass without shuffle; a worker's tables have ``chunks`` entries at
    most, fewer take less memory and more time.
    """

    def columns(rows):
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

    return _encoded(docs, file, id_col, text_col, "n_tokens long, ids string, decoded string", columns, chunks)


def encoding_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: digests of what encode_texts gives, worked out where it arises.

    Nulls, empty and long texts, repeats, null ids, empty tables and other columns are as there.
    """

    def columns(rows):
        digests = [[sha256(r[i].encode()).hexdigest() for r in rows] for i in (1, 2)]
        return [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(d, pa.string()) for d in digests)]

    return _encoded(docs, file, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns, chunks)
