"""Chunking of texts: sliding windows, packed lines, and scopes with balanced braces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import ESCAPED, LITERAL, headed
from ..ship import to_workers


def sliding(docs: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """One row a window: chunk_index, chunk_start, chunk_end and chunk. An empty text has no window; the last may be short."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, n = size - overlap, F.length(text_col)
    count = F.when(n > 0, F.greatest(F.lit(1), F.ceil((n - overlap) / step)))
    indexed = docs.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    start = F.col("chunk_index") * step
    return indexed.withColumn("chunk_start", start).withColumn("chunk_end", F.least(start + size, n)).withColumn("chunk", F.substring(F.col(text_col), start + 1, F.lit(size)))


def packed_lines(docs: DataFrame, text_col: str, limit: int, carry: int = 0) -> DataFrame:
    """Lines packed greedily into chunks of at most ``limit`` characters; each next chunk repeats the last ``carry`` lines."""
    to_workers(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def pack(texts):
        return texts.map(lambda t: pack_lines(t or "", limit, carry))

    return docs.withColumn("chunk_index_chunk", F.explode(F.transform(pack(F.col(text_col)), lambda c, i: F.struct(i.alias("chunk_index"), c.alias("chunk"))))).select(*docs.columns, "chunk_index_chunk.*")


def pack_lines(text: str, limit: int, carry: int) -> list[str]:
    chunks, held, fresh = [], [], 0
    for line in text.split("\n"):
        if fresh and sum(map(len, held)) + len(held) + len(line) > limit:
            chunks.append("\n".join(held))
            held, fresh = (held[-carry:] if carry else []), 0
        held.append(line)
        fresh += 1
    if fresh and (text or chunks):
        chunks.append("\n".join(held))
    return chunks


def split_at_delimiters(text: str, limit: int, delimiters: str = "\n;}") -> list[str]:
    """Pieces, each cut behind the last delimiter within ``limit`` characters or right after them, else at the limit."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = max(text.rfind(d, at + 1, at + limit + 1) for d in delimiters)
        end = cut + 1 if cut > at else at + limit
        pieces.append(text[at:end])
        at = end
    return [*pieces, text[at:]] if at < len(text) else pieces


SCOPE = r"\b(contract|interface|library)\s+(\w+)[^{;]*"


def hidden(text: str) -> str:
    """The text with blanks for strings and comments, as functions/structure.masked() gives it for a column."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(LITERAL.replace(r"\z", r"\Z"), blank, re.sub(ESCAPED, "  ", text))


def balanced(code: str, opening: int) -> int:
    """Offset after the brace that closes the one at ``opening`` of masked code; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opening):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def scopes(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, start_line, end_line, code) of each scope, by balanced braces outside of strings and comments."""
    out, code = [], hidden(text or "")
    for m in re.finditer(SCOPE + r"\{", code):
        end = balanced(code, m.end() - 1)
        out.append((m[1], m[2], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, end) + 1, text[m.start() : end]))
    return out


def scope_chunks(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a scope: kind, name, start_line, end_line, code."""
    to_workers(files.sparkSession)
    found = files.select("*", F.explode(headed(F.col(text_col), SCOPE, "kind", "name")).alias("scope"))
    return found.select(*files.columns, "scope.kind", "scope.name", "scope.start_line", "scope.end_line", F.col("scope.whole").alias("code"))


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    prefix = F.substr(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


FUNCTION = r"\bfunction\s+(\w+)\s*\([^)]*\)[^{};]*"


def function_scopes(text: str, line: int = 1) -> list[tuple[str, int, int, str]]:
    """(name, start_line, end_line, code) of each function, by balanced braces; ``line`` is that of the text's start."""
    out, at, code = [], 0, hidden(text)
    while m := re.compile(FUNCTION + r"\{").search(code, at):
        at = balanced(code, m.end() - 1)
        out.append((m[1], line + text.count("\n", 0, m.start()), line + text.count("\n", 0, at), text[m.start() : at]))
    return out


def cascade(text: str, limit: int) -> list[tuple[str, str | None, str | None, int, int, str]]:
    """(kind, contract, name, start_line, end_line, code): contracts, those over ``limit`` by their functions, or functions where
    there is no contract; if there are none, or one is over the limit, also packed lines that hold a line outside of all of them."""
    if not text.strip():
        return []
    chunks = []
    found = scopes(text)
    for _, contract, start, end, code in found:
        inner = function_scopes(code, start) if len(code) > limit else []
        chunks += [("function", contract, *f) for f in inner] or [("contract", contract, None, start, end, code)]
    if not found:
        chunks = [("function", None, *f) for f in function_scopes(text)]
    if not chunks or any(len(c[-1]) > limit for c in chunks):
        covered, line = {n for c in chunks for n in range(c[3], c[4] + 1)}, 1
        for packed in pack_lines(text, limit, 0):
            end = line + packed.count("\n")
            if not covered.issuperset(range(line, end + 1)):
                chunks.append(("lines", None, None, line, end, packed))
            line = end + 1
    return chunks


def hierarchy(text: str, limit: int) -> list[tuple[str, str | None, str | None, int, int, str]]:
    """(kind, contract, name, part, parts, code): the whole text if it fits, else contracts that fit, else their declaration up
    to the first function, and their functions, those over ``limit`` in parts."""
    if len(text) <= limit:
        return [("full_contract", None, None, 1, 1, text)] if text else []
    out = []
    for _, contract, _, _, code in scopes(text):
        if len(code) <= limit:
            out.append(("contract", contract, None, 1, 1, code))
            continue
        functions = function_scopes(code)
        out.append(("contract_declaration", contract, None, 1, 1, code[: code.index(functions[0][3])] if functions else code))
        for name, _, _, body in functions:
            parts = split_at_delimiters(body, limit) if len(body) > limit else [body]
            out += [("function_part" if len(parts) > 1 else "function", contract, name, i, len(parts), p) for i, p in enumerate(parts, 1)]
    return out


def sentence_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed to at most ``size`` characters, unless one is longer; the next piece begins with the last ones of the piece
    before that fit in ``overlap``."""
    pieces, held, fresh = [], [], 0
    for sentence in filter(None, re.split(r"(?<=[.!?])\s+", text.strip())):
        if fresh and sum(map(len, held)) + len(held) + len(sentence) > size:
            pieces.append(" ".join(held))
            kept: list[str] = []
            while held and sum(map(len, kept)) + len(kept) + len(held[-1]) <= overlap:
                kept.insert(0, held.pop())
            held, fresh = kept if sum(map(len, kept)) + len(kept) + len(sentence) <= size else [], 0
        held.append(sentence)
        fresh += 1
    return [*pieces, " ".join(held)] if fresh else pieces


def _exploded(files: DataFrame, text_col: str, cut, schema: str) -> DataFrame:
    to_workers(files.sparkSession)
    names = [f.split(":")[0] for f in schema.split(",")]

    @F.pandas_udf(f"array<struct<{schema}>>")
    def rows(texts):
        return texts.map(lambda t: [dict(zip(names, r)) for r in cut(t or "")])

    kept = [c for c in files.columns if c != text_col]
    return files.select(*kept, F.posexplode(rows(F.col(text_col))).alias("chunk_index", "c")).select(*kept, "chunk_index", "c.*")


def function_chunks(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a function, nested ones too: chunk_index, name, start_line, end_line, code."""
    to_workers(files.sparkSession)
    kept = [c for c in files.columns if c != text_col]
    found = files.select(*kept, F.explode(headed(F.col(text_col), FUNCTION, "name")).alias("f"))
    return found.select(*kept, F.col("f.ordinal").alias("chunk_index"), "f.name", "f.start_line", "f.end_line", F.col("f.whole").alias("code"))


def cascade_chunks(files: DataFrame, limit: int, text_col: str = "content") -> DataFrame:
    return _exploded(files, text_col, lambda t: cascade(t, limit), "kind:string,contract:string,name:string,start_line:int,end_line:int,code:string")


def hierarchical_chunks(files: DataFrame, limit: int, text_col: str = "content") -> DataFrame:
    return _exploded(files, text_col, lambda t: hierarchy(t, limit), "kind:string,contract:string,name:string,part:int,parts:int,code:string")


def sentence_chunks(docs: DataFrame, size: int = 1024, overlap: int = 200, text_col: str = "text") -> DataFrame:
    return _exploded(docs, text_col, lambda t: [(p,) for p in sentence_pieces(t, size, overlap)], "chunk:string")
