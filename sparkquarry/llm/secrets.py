"""Secret scans: fixed patterns, and spans whose characters a battery of randomness tests can't tell from random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

#: Fixed patterns of the contract, in the order of kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates for the battery: runs of characters that encodings of keys use, and their parts between / _ and -, which join
#: paths and names too. ``=`` ends a run as padding; before more of a run it stands between a name and its value.
PADDING = r"(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
RUN = r"[A-Za-z0-9+/_-]{20,}" + PADDING
PART = r"[A-Za-z0-9+]{20,}" + PADDING
#: A run a tenth of which are words of small letters between separators is a path or a name: its parts alone are tested.
NAMED = r"(^|[/_-])[A-Z]?[a-z]{2,}([/_-]|$)"
#: Inferred encodings: name, pattern that the whole run matches, alphabet in the order of its values, and the sum of squared
#: frequencies of natural text over the alphabet (letters of words, or years, counters and phone numbers for digits).
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.16),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.13),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 0.13),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("lower36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    ("base62", "^[A-Za-z0-9]+=*$", LETTERS, 0.06),
    ("base64", "^[A-Za-z0-9+/]+=*$", LETTERS + "+/", 0.06),
    ("base64url", "^[A-Za-z0-9_-]+=*$", LETTERS + "-_", 0.06),
)
#: A run counts as random if no test rejects uniformity at this level, ...
REJECT = 0.001
#: ... and as a discovery if it is too uniform for natural text of its length, at this false discovery rate among all runs of the corpus.
FDR = 0.01
#: Steps of p-values, by powers of ten, that candidates are counted by, and the least power.
STEPS, LEAST = 50, 20
#: Characters of a run whose serial products are added at a time, and elements of an array that are folded at a time.
STRETCH, CHUNK = 4096, 256
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _phi(z: str) -> str:
    """SQL of the normal distribution function, by a logistic polynomial (error below 0.0002, in proportion in the lower tail)."""
    z = f"greatest(least({z}, 8D), -8D)"
    return f"(1D / (1D + exp(-(0.070565992D * pow({z}, 3) + 1.5976D * {z}))))"


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body over ``name``, which stands for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _folded(items: str, start: str, step: str, out: str, kept: str) -> str:
    """SQL of an array of ``out`` for each x of items in order for which ``kept`` is true; ``s``, a number, begins as
    ``start`` and is ``step`` after x; out and kept see it as it is after x, and the one before as ``acc.s``.

    Elements are folded by chunks, so that appending to arrays takes time in proportion to their size.
    """
    empty = f"cast(array() as array<{SPAN}>)"
    one = f"transform(array({step}), s -> named_struct('s', s, 'out', if({kept}, concat(acc.out, array({out})), acc.out)))[0]"
    inner = f"aggregate(slice(items, i * {CHUNK} + 1, {CHUNK}), named_struct('s', all.s, 'out', {empty}), (acc, x) -> {one})"
    outer = f"(all, i) -> {_bound(inner, 'part', "named_struct('s', part.s, 'out', concat(all.out, array(part.out)))")}"
    folded = f"aggregate(sequence(0, (size(items) - 1) div {CHUNK}), named_struct('s', {start}, 'out', cast(array() as array<array<{SPAN}>>)), {outer}, all -> flatten(all.out))"
    return _bound(items, "items", f"if(size(items) = 0, {empty}, {folded})")


def _spans(text: str, pattern: str, kind: int, least: int = 0) -> str:
    r"""SQL of an array of (start, kind, end): code points of all leftmost non-overlapping matches.

    ``\G`` ties each match to the end of the one before, so that gaps and matches cover the text up to the last match and
    their lengths give positions. With ``least``, only matches whose own group has that many characters stay.
    """
    whole = (r"\G(?s:(.*?))(" + pattern + ")").replace("\\", "\\\\").replace("'", "\\'")
    sizes = [f"transform(regexp_extract_all({text}, '{whole}', {g}), x -> length(x))" for g in (0, 2, 3 if least else 2)]
    span = f"named_struct('start', s - x['1'], 'kind', {kind}, 'end', s)"
    return _folded(f"arrays_zip({', '.join(sizes)})", "0L", "acc.s + x['0']", span, f"x['2'] >= {least}")


def _guarded(present: str, spans: str) -> str:
    return f"if({present}, {spans}, cast(array() as array<{SPAN}>))"


def _free(candidates: str, base: str) -> str:
    """SQL of the candidates that overlap no base span; candidates have kind 3, so of equal starts base ones come first."""
    span = "named_struct('start', x.start, 'kind', x.kind, 'end', x.end)"
    forth = _folded(f"array_sort(concat({candidates}, {base}))", "-1L", "if(x.kind < 3, greatest(acc.s, x.end), acc.s)", span, "x.kind < 3 or s <= x.start")
    back = _folded(f"reverse({forth})", f"{(1 << 62)}L", "if(x.kind < 3, least(acc.s, x.start), acc.s)", span, "x.kind = 3 and s >= x.end")
    return f"reverse({back})"


def _outer(spans: str) -> str:
    """SQL of the spans that lie in no other; each occurs once."""
    by_size = f"array_sort({spans}, (x, y) -> case when x.start <> y.start then int(sign(x.start - y.start)) else int(sign(y.end - x.end)) end)"
    return _folded(by_size, "-1L", "greatest(acc.s, x.end)", "named_struct('start', x.start, 'kind', x.kind, 'end', x.end)", "x.end > acc.s")


def _tests(run: str) -> str:
    """SQL of (chi, runs, serial, p_text) of a run over its inferred alphabet: upper or two-sided p-values of uniformity,
    and the chance that natural text of its length looks as uniform; null without an encoding."""
    cases = []
    for _, pattern, alphabet, natural in ENCODINGS:
        k, low = len(alphabet), "".join("L" if i < len(alphabet) / 2 else "H" for i in range(len(alphabet)))
        codes = f"transform(split(b, ''), c -> instr('{alphabet}', c) - {(k + 1) / 2}D)"
        products = _bound(codes, "v", "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (x, y) -> coalesce(x * y, 0D)), 0D, (a, x) -> a + x)")
        blocks = f"regexp_extract_all(rtrim('=', r), '.{{1,{STRETCH}}}', 0)"
        fit = f"""named_struct('n', cast(length(rtrim('=', r)) as double), 'k', {k}D, 'natural', {natural}D,
            'squares', aggregate(split('{alphabet}', ''), 0D, (a, c) -> a + if(c = '', 0D, pow(length(r) - length(replace(r, c, '')), 2))),
            'serial', aggregate({blocks}, 0D, (a, b) -> a + {products}), 'pairs', cast(length(rtrim('=', r)) - size({blocks}) as double),
            'halves', translate(rtrim('=', r), '{alphabet}', '{low}'))"""
        cases.append(f"when r rlike '{pattern}' then {fit}")
    fit = f"transform(array({run}), r -> case {' '.join(cases)} end)"
    first = f"""transform({fit}, f -> if(f is null, null, named_struct('n', f.n, 'k', f.k, 'natural', f.natural, 'chi', f.k / f.n * f.squares - f.n, 'serial', f.serial, 'pairs', f.pairs,
        'lows', cast(length(replace(f.halves, 'H', '')) as double), 'runs', cast(regexp_count(f.halves, 'L+|H+') as double))))"""
    second = f"""transform({first}, f -> if(f is null, null, named_struct('f', f, 'mean_runs', 2 * f.lows * (f.n - f.lows) / f.n + 1, 'excess', f.n * (f.k * f.natural - 1))))"""
    chi = "(pow(greatest(g.f.chi, 0D) / (g.f.k - 1), 1 / 3D) - (1 - 2 / (9 * (g.f.k - 1)))) / sqrt(2 / (9 * (g.f.k - 1)))"
    runs = "abs(g.f.runs - g.mean_runs) / sqrt(greatest((g.mean_runs - 1) * (g.mean_runs - 2) / (g.f.n - 1), 0.25D))"
    serial = "abs(g.f.serial) / ((g.f.k * g.f.k - 1) / 12 * sqrt(greatest(g.f.pairs, 1D)))"
    text = "(g.f.chi - (g.f.k - 1 + g.excess)) / sqrt(2 * (g.f.k - 1 + 2 * g.excess))"
    return f"""transform({second}, g -> if(g is null, null, named_struct('chi', 1 - {_phi(chi)}, 'runs', 2 * (1 - {_phi(runs)}), 'serial', 2 * (1 - {_phi(serial)}), 'p_text', {_phi(text)})))[0]"""


def _cut(steps: dict[int, int]) -> float:
    """The largest p-value step at which Benjamini-Hochberg calls the runs below it discoveries, from the numbers of runs by step.

    A run of step i has a p-value above 10 ** -((i + 1) / STEPS) and of 10 ** -(i / STEPS) at most.
    """
    total, below = sum(steps.values()), 0
    best = -1.0
    for step in sorted(steps, reverse=True):
        below += steps[step]
        if total * 10 ** (-step / STEPS) <= FDR * below:
            best = 10 ** (-step / STEPS)
    return best


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of each row: arrays of (start, kind, end), kind an index into KINDS, in code points.

    ``base`` are the matches of the fixed patterns. ``added`` are runs of key-like characters outside of them for which
    the battery (chi-squared uniformity, runs about the middle of the alphabet, serial correlation; each over the
    alphabet of the inferred encoding) rejects nothing, and which Benjamini-Hochberg, over the runs of all documents, with
    p-values for natural text of a run's length, calls too uniform. So short runs need to be more even than long ones, and
    of all spans that are added a hundredth is expected to be natural text, whatever the number of documents. The parts of
    a run between separators are tested as well, and count where the run as a whole doesn't.

    Texts are read once: spans and p-values, without texts, go to a table; the driver gets its numbers of runs by step of
    p-value, a thousand at most. Null or empty text has no spans. Repeated rows, null ids and texts of any length give a row
    each, in time in proportion to the text; other columns are ignored, whatever their names; no rows give no rows.
    """
    assign_in = " or ".join(f"contains(lower(t), '{w}')" for w in ("password", "passwd", "secret", "token", "api"))
    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).selectExpr(
        "id", "t",
        f"{_guarded(assign_in, _spans('t', ASSIGN, 0, 8))} as assign",
        f"{_guarded("contains(t, 'AKIA')", _spans('t', ACCESS, 1))} as access",
        f"{_guarded(f"t rlike '{HEX}'", _spans('t', HEX, 2))} as hex",
        f"{_guarded(f"t rlike '{RUN}'", f"array_union({_spans('t', RUN, 3)}, {_spans('t', PART, 3)})")} as candidates",
    )
    based = found.selectExpr("id", "t", "array_sort(concat(assign, access, hex)) as base", "candidates")
    free = based.selectExpr("id", "t", "base", f"if(size(candidates) = 0 or size(base) = 0, candidates, {_free('candidates', 'base')}) as free")
    run = "substr(t, int(c.start) + 1, int(c.end - c.start))"
    tested = free.selectExpr("id", "base", f"transform(free, c -> {_bound(run, 'u', f"named_struct('span', c, 'test', if(u rlike '{NAMED}' and 10 * (length(u) - length(regexp_replace(u, '{NAMED}', ''))) > length(u), null, {_tests('u')}))")}) as tested")
    fits = f"least(x.test.chi, x.test.runs, x.test.serial) >= {REJECT}D / 3"
    level = f"least(greatest(int(floor(-log10(greatest(x.test.p_text, 1e-{LEAST + 1}D)) * {STEPS})), 0), {LEAST * STEPS})"
    narrow = tested.selectExpr("id", "base", f"transform(filter(tested, x -> x.test is not null), x -> named_struct('span', x.span, 'fits', {fits}, 'step', {level})) as runs")
    narrow = checkpointed(narrow)
    cut = _cut(dict(narrow.select(F.explode("runs.step").alias("step")).groupBy("step").count().collect()))
    least = math.ceil(-math.log10(cut) * STEPS - 1e-9) if cut > 0 else LEAST * STEPS + 1
    passed = f"transform(filter(runs, x -> x.fits and x.step >= {least}), x -> x.span)"
    return narrow.selectExpr(f"id as `{id_col}`", "base", f"{_outer(passed)} as added")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("added").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
    )
