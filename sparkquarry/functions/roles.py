"""What functions are for, by name, flags and body; and measures of code: branches of functions, lines of code and comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code as C
from .structure import bound, masked

#: The type of a function by its name in lower case, where nothing before decides; the first that fits.
NAMED = (
    ("getter", "^(?:get|is|has)"), ("setter", "^set"), ("withdrawal", "withdraw"), ("deposit", "deposit|receive"), ("transfer", "transfer|send"), ("mint", "mint"), ("burn", "burn"),
    ("approval", "approve|allow"), ("claim", "claim"), ("staking", "stake"), ("swap", "swap|exchange"), ("initialization", "init"),
)
#: Functions that are special by themselves, names of access control, and words by which a body has a trait.
SPECIAL, ACCESS = ("constructor", "fallback", "receive", "modifier"), "^only|auth|admin|owner"
TRAITS = {
    "token_transfer": ("transfer", "transferFrom", "balanceOf", "approve", "allowance"),
    "access_control": ("require", "onlyOwner", "onlyAdmin", "modifier", "isOwner", "auth", "access"),
    "state_transition": ("state", "status", "stage"),
    "external_call": (".call{", ".call(", ".delegatecall", ".staticcall", "interface", "external"),
    "fund_management": ("wei", "ether", "value", "msg.value", "balance", "deposit", "withdraw"),
}
#: What branches: words and operators of masked code.
BRANCHES = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"


def function_type(name: Column, special: Column, is_view: Column, is_pure: Column, is_payable: Column) -> Column:
    """Type of a function: what it is by itself (``special``, one of SPECIAL or null), by a name of access control, by its flags, by name."""
    low = F.lower(name)
    out = F.when(special.isin(*SPECIAL), special).when(low.rlike(ACCESS), "access_control").when(is_view | is_pure, "view").when(is_payable, "payable")
    for kind, pattern in NAMED:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("unknown")


def traits(name: Column, text: Column) -> Column:
    """Array of the traits that a function's text has, in the order of TRAITS; a state is changed only where something is assigned."""
    has = {k: F.greatest(*(text.contains(w) for w in words), F.lit(False)) for k, words in TRAITS.items()}
    has["token_transfer"] = has["token_transfer"] | F.lower(name).contains("transfer")
    has["state_transition"] = has["state_transition"] & text.contains("=")
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in has.items())))


def classified(files: DataFrame, text_col: str = "content") -> DataFrame:
    """Functions and modifiers of files with their type and traits: name, type, traits, start_line, beside the columns of files but the text."""
    kept = [c for c in files.columns if c != text_col]
    named = C.functions(files, text_col)
    special = F.when(F.lower("name").isin("constructor", "fallback"), F.lower("name"))
    own = named.select(*kept, "name", function_type(F.col("name"), special, F.col("is_view"), F.col("is_pure"), F.col("is_payable")).alias("type"), traits(F.col("name"), F.col("whole")).alias("traits"), "start_line")
    nameless = C.blocks_of(files, text_col, r"\b(constructor|fallback|receive)\s*\([^)]*\)[^{};]*", "name")
    found = own.unionByName(nameless.select(*kept, "name", F.col("name").alias("type"), traits(F.col("name"), F.col("whole")).alias("traits"), "start_line"))
    return found.unionByName(C.modifiers(files, text_col).select(*kept, "name", F.lit("modifier").alias("type"), traits(F.col("name"), F.col("whole")).alias("traits"), "start_line"))


def branches(files: DataFrame, text_col: str = "content") -> DataFrame:
    """(name, start_line, complexity) of each function: one more than its branches in code, beside the columns of files but the text."""
    kept = [c for c in files.columns if c != text_col]
    return C.functions(files, text_col).select(*kept, "name", "start_line", (F.regexp_count(masked(F.col("body")), F.lit(BRANCHES)) + 1).alias("complexity"))


def line_counts(text: Column) -> Column:
    """(total, code, comment, blank, code_ratio, comment_ratio): lines with code, comments alone, and nothing; ratios are 0 of no lines."""
    split = lambda c: F.split(c, "\n")
    lines = F.arrays_zip(split(text).alias("raw"), split(masked(text, strings=False)).alias("code"))

    def counted(own: Column) -> Column:
        code = F.size(F.filter(own, lambda x: F.trim(x["code"]) != ""))
        comment = F.size(F.filter(own, lambda x: (F.trim(x["code"]) == "") & (F.trim(x["raw"]) != "")))
        total = F.when(text == "", 0).otherwise(F.size(own))
        ratio = lambda n: F.coalesce(F.try_divide(n, total), F.lit(0.0))
        return F.struct(total.alias("total"), code.alias("code"), comment.alias("comment"), (total - code - comment).alias("blank"), ratio(code).alias("code_ratio"), ratio(comment).alias("comment_ratio"))

    return bound(F.transform(lines, lambda x: x), counted)


def insights(texts: DataFrame, group: list[str], text_col: str = "text", k: int = 5) -> DataFrame:
    """(group, texts, words, distinct_words, diversity, mean_words, top): words are what white space parts, in lower case; ``top`` has the k
    most frequent as word:count, ties by word. Words are counted before they meet."""
    from ..operators.windows import top_per_group

    words = texts.select(*group, F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    counts = words.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(*group).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))
    best = top_per_group(counts, group, [F.desc("n"), "word"], k).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "word", F.col("n").cast("string")).alias("t")))).alias("r"))
    whole = texts.groupBy(*group).agg(F.count(F.lit(1)).alias("texts")).join(sums, group, "left").join(best, group, "left")
    none = F.array().cast("array<string>")
    return whole.select(
        *group, "texts", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("distinct_words", F.lit(0)).alias("distinct_words"), F.coalesce(F.try_divide("distinct_words", "words"), F.lit(0.0)).alias("diversity"),
        (F.coalesce("words", F.lit(0)) / F.col("texts")).alias("mean_words"), F.coalesce(F.col("r.t"), none).alias("top"),
    )
