"""Source metrics of one text, as column expressions over lines and tokens.

Everything stays in the row: state machines are folds over the line array, token rules are
regular expressions.  Word boundaries are explicit ASCII look-arounds, because ``\\b`` also
treats accented letters as word characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import once

#: Marker words of stale decisions, hash-comment extensions, size limits.
STALE_MARKERS = ("TODO", "FIXME", "HACK", "XXX", "DEPRECATED", "STALE")
HASH_COMMENT_EXTENSIONS = r"(?i)\.(py|rb|sh|bash|yaml|yml|toml|pl)$"
FULL_BYTES, FULL_LINES, SAMPLE_BYTES, CLONE_BYTES = 96 * 1024, 4000, 48 * 1024, 24
#: Words that Halstead counts as operators.
OPERATOR_WORDS = (
    "if", "else", "elif", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "catch", "try",
    "finally", "new", "delete", "typeof", "instanceof", "in", "of", "await", "yield", "void", "with", "and", "or", "not",
)
#: Words before a parenthesis that are no calls.
NO_CALLS = (
    "if", "for", "while", "switch", "catch", "elif", "elseif", "function", "fn", "def", "class", "new", "typeof", "sizeof", "return", "throw", "raise",
)

#: A text as a sequence of comments, literals and other runs.
PARTS = r"""/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|#[^\n]*|'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\\?\z)|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(?:`|\\?\z)|[^/#'"`]+|/"""
SYMBOLS = r"===|!==|\.\.\.|=>|\+\+|--|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|<<|>>|\*\*|::|[-+*/%&|^~!<>=?:;,.(){}\[\]]"
TOKENS = SYMBOLS + r"|[0-9][0-9.]*|[A-Za-z_$][A-Za-z0-9_$]*"
#: ``TOKENS`` and the two below as the queries use them: the same matches, but a place where none starts fails at one class of characters.
SCANNED_TOKENS = r"[A-Za-z_$][A-Za-z0-9_$]*+|[0-9][0-9.]*+|[,;(){}\[\]~]|(?=[-!%&*+./:<=>?^|])(?:" + SYMBOLS + ")"
ASSIGNMENTS = r"===|!==|==|=>|!=|<=|>=|:=|[-+*/%|&^]=|="
SCANNED_ASSIGNMENTS = f"(?=[-!%&*+/:<=>^|])(?:{ASSIGNMENTS})"
CALLS = r"[A-Za-z_$][A-Za-z0-9_$]*\s*\("
SCANNED_CALLS = r"(?=[A-Za-z_$])(?<![A-Za-z_$])([A-Za-z_$][A-Za-z0-9_$]*+)\s*+\("
#: Fixed value: every token that ``SYMBOLS`` matches.
SYMBOL_TOKENS = (
    "===", "!==", "...", "=>", "++", "--", "&&", "||", "??", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "==", "!=", "<=", ">=", "<<", ">>", "**", "::",
    *"-+*/%&|^~!<>=?:;,.(){}[]",
)


def lines_of(text: Column) -> Column:
    """Lines without their ends; one final line end adds no line, an empty text has none.

    A single character splits without a regular expression, so only texts with carriage returns need one.
    """
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    ended = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).when(F.contains(text, F.lit("\r")), ended).otherwise(F.split(body, "\n", -1))


#: Fixed value: the characters of Unicode's white space.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(line: Column) -> Column:
    """``line`` without white space at its ends; only ends beyond printable ASCII are compared with all of ``BLANKS``."""
    plain = lambda c: F.ascii(c).between(0x21, 0x7E)
    spaced = F.trim(line)
    return F.when(plain(spaced) & plain(F.right(spaced, F.lit(1))), spaced).otherwise(F.btrim(line, F.lit(BLANKS)))


def trimmed_lines(text: Column) -> Column:
    return F.transform(lines_of(text), trimmed)


def strip_noise(text: Column) -> Column:
    """Comments out, literals to `` str ``; an unterminated one reaches the end of the text."""
    parts = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    short = lambda p: (
        F.when(F.startswith(p, F.lit("/*")), F.lit(" "))
        .when(F.startswith(p, F.lit("//")) | F.startswith(p, F.lit("#")), F.lit(""))
        .when(F.left(p, F.lit(1)).isin("'", '"', "`"), F.lit(" str "))
        .otherwise(p)
    )
    return F.array_join(F.transform(parts, short), "")


def sample(text: Column) -> Column:
    """The first bytes of a text that classic metrics look at, whole characters only."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, SAMPLE_BYTES), "UTF-8")
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(F.regexp_replace(head, "�+\\z", ""))


def word_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")).cast("long")


def text_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def literal_count(text: Column, part: str) -> Column:
    """How often ``part``, ASCII characters, stands in a text without overlap."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return (gone if len(part) == 1 else F.shiftright(gone, 1) if len(part) == 2 else F.floor(gone / len(part))).cast("long")


#: Words that decide, that jump, and that test.
DECIDE = ("if", "elif", "for", "while", "case", "catch", "switch")
JUMP = ("return", "goto", "throw", "raise")
TEST = ("if", "elif", "case", "while", "for", "catch", "except")
#: A place is tried only where some word may start.
KEYWORDS = "(?=[CEFGIRSTWcefgirstw])(?<![A-Za-z0-9_])(?i:(" + "|".join(sorted({*DECIDE, *JUMP, *TEST})) + "))(?![A-Za-z0-9_])"


#: Words that cost in ``cognitive``.
CONTROL = r"(?=[CEFISWcefisw])(?<![A-Za-z0-9_])(?i:if|for|while|switch|catch|except|elif)(?![A-Za-z0-9_])"


def keywords(code: Column) -> Column:
    """Lower-cased words of control flow in stripped text, in order."""
    return F.transform(F.regexp_extract_all(code, F.lit(KEYWORDS), F.lit(1)), lambda w: F.lower(w))


def _among(words: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*names))).cast("long")


def _marks(code: Column) -> Column:
    return literal_count(code, "&&") + literal_count(code, "||") + literal_count(code, "?")


def cyclomatic(code: Column, words: Column | None = None) -> Column:
    """One plus the decision points of stripped text; ``else if`` counts twice by definition."""
    found = keywords(code) if words is None else words
    return (_among(found, DECIDE) + literal_count(code, "else if") + literal_count(code, "else\tif") + _marks(code) + 1).cast("double")


def halstead_tokens(code: Column) -> Column:
    """Operators and operands of stripped text in order; operator words are lower-cased."""
    tokens = F.regexp_extract_all(code, F.lit(SCANNED_TOKENS), F.lit(0))
    lowered = lambda ts: F.transform(ts, lambda t: F.when(F.lower(t).isin(*OPERATOR_WORDS), F.lower(t)).otherwise(t))
    return once(tokens, lambda ts: F.when(code == F.lower(code), ts).otherwise(lowered(ts)))


def halstead(tokens: Column) -> Column:
    """Struct (n1, n2, t1, t2): distinct and total operators and operands, each at least 1.

    A token is one or the other by its text, so operands are what the operators leave.
    """
    operators = lambda c: F.size(F.filter(c, lambda t: t.isin(*SYMBOL_TOKENS, *OPERATOR_WORDS)))
    at_least_one = lambda c: F.greatest(c, F.lit(1)).cast("long")

    def counted(x: Column) -> Column:
        return F.struct(at_least_one(x["n1"]).alias("n1"), at_least_one(x["n"] - x["n1"]).alias("n2"), at_least_one(x["t1"]).alias("t1"), at_least_one(x["t"] - x["t1"]).alias("t2"))

    sizes = lambda kinds: F.struct(F.size(kinds).alias("n"), operators(kinds).alias("n1"), F.size(tokens).alias("t"), operators(tokens).alias("t1"))
    return once(once(F.array_distinct(tokens), sizes), counted)


def volume(h: Column) -> Column:
    return (h["t1"] + h["t2"]) * F.log2((h["n1"] + h["n2"]).cast("double"))


def difficulty(h: Column) -> Column:
    return (h["n1"] / F.lit(2.0)) * (h["t2"] / h["n2"])


def maintainability(v: Column, cc: Column, loc: Column) -> Column:
    raw = F.lit(171.0) - 5.2 * F.log(F.greatest(v, F.lit(1.0))) - 0.23 * F.greatest(cc, F.lit(1.0)) - 16.2 * F.log(F.greatest(loc.cast("double"), F.lit(1.0)))
    return F.least(F.greatest(raw * 100.0 / 171.0, F.lit(0.0)), F.lit(100.0))


def abc(code: Column, words: Column | None = None) -> Column:
    """Struct (assignments, branches, conditions) of stripped text."""
    found = keywords(code) if words is None else words
    assigned = F.filter(F.regexp_extract_all(code, F.lit(SCANNED_ASSIGNMENTS), F.lit(0)), lambda t: t.isin("=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^="))
    called = F.filter(F.regexp_extract_all(code, F.lit(SCANNED_CALLS), F.lit(1)), lambda t: ~F.lower(t).isin(*NO_CALLS))
    return F.struct(
        F.size(assigned).cast("long").alias("a"), (_among(found, JUMP) + F.size(called)).alias("b"), (_among(found, TEST) + _marks(code)).alias("c")
    )


def magnitude(x: Column) -> Column:
    return F.sqrt((x["a"] * x["a"] + x["b"] * x["b"] + x["c"] * x["c"]).cast("double"))


def cognitive(code: Column) -> Column:
    """Line by line: control flow costs one plus the nesting before the line.

    Lines are only searched for what stands anywhere in the text.
    """
    none = F.lit(0).cast("long")

    def step(acc: Column, t: Column, has: Column) -> Column:
        nest = acc["nest"]
        # ``else if`` holds the word ``if``, unless letters go on after it.
        control = F.regexp_like(t, F.lit(CONTROL)) | (has["else"] & F.contains(t, F.lit("else if")))
        only_else = has["else"] & F.regexp_like(t, F.lit(r"(?=[Ee])(?<![A-Za-z0-9_])(?i:else)(?![A-Za-z0-9_])")) & ~F.contains(t, F.lit("else if"))
        asked = F.when(has["ask"], literal_count(t, "??")).otherwise(none)
        logical = F.when(has["both"], literal_count(t, "&&")).otherwise(none) + F.when(has["either"], literal_count(t, "||")).otherwise(none) + asked
        ternary = F.when(has["ask"] & ~F.contains(t, F.lit("?:")), literal_count(t, "?")).otherwise(none)
        cost = F.when(control, nest + 1).when(only_else, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        depth = F.greatest(nest + literal_count(t, "{") - literal_count(t, "}"), F.lit(0).cast("long"))
        return F.struct((acc["score"] + cost + logical + ternary * (nest + 1)).alias("score"), depth.alias("nest"))

    zero = F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("nest"))
    marks = {"else": F.regexp_like(code, F.lit("(?i:else)")), "both": F.contains(code, F.lit("&&")), "either": F.contains(code, F.lit("||")), "ask": F.contains(code, F.lit("?"))}
    fold = lambda has: F.aggregate(trimmed_lines(code), zero, lambda acc, t: step(acc, t, has), lambda acc: acc["score"].cast("double"))
    return once(F.struct(*[v.alias(k) for k, v in marks.items()]), fold)


def inheritance_depth(code: Column) -> Column:
    n = literal_count(code, " extends ")
    heads = (F.contains(code, F.lit("class ")) | F.contains(code, F.lit("trait "))) & F.exists(
        trimmed_lines(code),
        lambda t: (F.startswith(t, F.lit("class ")) & F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")) & F.contains(t, F.lit(":")))
        | (F.startswith(t, F.lit("trait ")) & F.contains(t, F.lit(":"))),
    )
    return F.when(n >= 2, F.least(n, F.lit(5))).when((n == 1) | heads, F.lit(1)).otherwise(F.lit(0)).cast("double")


def line_breakdown(text: Column, path: Column, lines: Column | None = None) -> Column:
    """Struct (loc, nloc, cloc, blank, stale); block comments are followed across lines.

    ``lines`` are the trimmed lines of ``text``, where they are known.
    """
    is_stale = lambda t: F.regexp_like(t, F.lit("(?=[TFHXDStfhxds])(?i:" + "|".join(STALE_MARKERS) + ")"))

    def step(acc: Column, t: Column, hashes: Column) -> Column:
        empty, opens, closes = t == "", F.contains(t, F.lit("/*")), F.contains(t, F.lit("*/"))
        marked = F.startswith(t, F.lit("//")) | (hashes & F.startswith(t, F.lit("#")))
        inside = acc["block"]
        comment = inside | F.startswith(t, F.lit("/*")) | marked
        block = F.when(empty, inside).when(closes, False).when(inside, True).otherwise(opens & ~marked)
        bump = lambda name, when: (acc[name] + F.when(when, 1).otherwise(0)).alias(name)
        return F.struct(block.alias("block"), bump("nloc", ~empty & ~comment), bump("cloc", ~empty & comment), bump("blank", empty), bump("stale", ~empty & is_stale(t)))

    zero = F.struct(F.lit(False).alias("block"), *[F.lit(0).alias(n) for n in ("nloc", "cloc", "blank", "stale")])
    done = lambda acc: F.struct(
        (acc["nloc"] + acc["cloc"] + acc["blank"]).cast("long").alias("loc"), *[acc[n].cast("long").alias(n) for n in ("nloc", "cloc", "blank", "stale")]
    )
    texts = trimmed_lines(text) if lines is None else lines
    return once(F.regexp_like(path, F.lit(HASH_COMMENT_EXTENSIONS)), lambda h: F.aggregate(texts, zero, lambda acc, t: step(acc, t, h), done))


def clone_lines(text: Column, path: Column, lines: Column | None = None) -> Column:
    """Code lines with single blanks, at least ``CLONE_BYTES`` bytes, no imports; ``lines`` as in ``line_breakdown``."""
    # Single blanks make no line longer.
    short = lambda t: F.octet_length(t) < CLONE_BYTES
    comment = lambda t, hashes: F.startswith(t, F.lit("//")) | (hashes & F.startswith(t, F.lit("#")))

    def step(acc: Column, t: Column, hashes: Column) -> Column:
        inside, opens, closes = acc["block"], F.startswith(t, F.lit("/*")), F.contains(t, F.lit("*/"))
        skipped = inside | opens | short(t) | comment(t, hashes)
        block = F.when(t == "", inside).when(inside | opens, ~closes).otherwise(False)
        return F.struct(block.alias("block"), F.when(skipped, acc["out"]).otherwise(F.array_append(acc["out"], t)).alias("out"))

    zero = F.struct(F.lit(False).alias("block"), F.array().cast("array<string>").alias("out"))
    texts = trimmed_lines(text) if lines is None else lines

    def code(hashes: Column) -> Column:
        # Without an opening mark there is no state to follow.
        plain = F.filter(texts, lambda t: ~(short(t) | comment(t, hashes)))
        return F.when(F.contains(text, F.lit("/*")), F.aggregate(texts, zero, lambda acc, t: step(acc, t, hashes), lambda acc: acc["out"])).otherwise(plain)

    single = lambda t: F.when(F.contains(t, F.lit("  ")) | F.regexp_like(t, F.lit("[^ -~]")), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)
    norms = F.transform(once(F.regexp_like(path, F.lit(HASH_COMMENT_EXTENSIONS)), code), single)
    imports = lambda norm: F.regexp_like(F.lower(F.left(norm, F.lit(9))), F.lit("^(import |use |from |package |#include)"))
    return F.filter(norms, lambda norm: ~(short(norm) | imports(norm)))


def per_kloc(count: Column, loc: Column) -> Column:
    return F.when(loc == 0, count * 1000.0).otherwise(count / loc * 1000.0)


def cohesion(symbols: Column, components: Column) -> Column:
    c = F.least(F.greatest(components, F.lit(1)), symbols)
    return F.when(symbols <= 1, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100.0 * (1.0 - (c - 1) / (symbols - 1))))


#: Fixed value: the fields of the classic metrics.
CLASSIC = ("cc", "cog", "vol", "diff", "mi", "a", "b", "c", "mag", "dit")


def with_classic_metrics(files: DataFrame, text: str = "content", loc: str = "loc", guard: bool = True, fields: Sequence[str] = CLASSIC) -> DataFrame:
    """``files`` plus ``m``: struct (cc, cog, vol, diff, mi, a, b, c, mag, dit), or those of ``fields``.

    Spark makes every field of a struct, also those that nobody reads.

    With ``guard`` texts beyond ``FULL_BYTES`` or ``FULL_LINES`` are approximated from their lines, as
    a viewer that must answer at once does; without it whole texts are measured.  Stripped text and
    tokens are columns of their own on the way, so that each is made once a row.
    """
    step = files.withColumn("__code", strip_noise(sample(F.col(text)) if guard else F.col(text)))
    code, words = F.col("__code"), F.col("__words")
    step = step.withColumns({"__tokens": halstead_tokens(code), "__words": keywords(code)})
    step = step.withColumns({"__h": halstead(F.col("__tokens")), "__x": abc(code, words), "__cc": cyclomatic(code, words), "__cog": cognitive(code), "__dit": inheritance_depth(code)})
    n = F.greatest(F.col(loc), F.lit(1)).cast("double")
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    size_cc, size_vol = clamp(n / 25.0, 1.0, 200.0), n * 12.5
    half = F.floor(size_cc / 2.0 + 0.5).cast("long")
    rough = F.struct(F.floor(n / 8.0 + 0.5).cast("long").alias("a"), half.alias("b"), half.alias("c"))
    large = (F.octet_length(text) > FULL_BYTES) | (F.col(loc) > FULL_LINES)

    def pack(cc: Column, cog: Column, vol: Column, diff: Column, x: Column, dit: Column) -> Column:
        made = (cc, cog, vol, diff, maintainability(vol, cc, n), x["a"], x["b"], x["c"], magnitude(x), dit)
        return F.struct(*[value.alias(name) for name, value in zip(CLASSIC, made, strict=True) if name in fields])

    exact = pack(F.col("__cc"), F.col("__cog"), volume(F.col("__h")), difficulty(F.col("__h")), F.col("__x"), F.col("__dit"))
    guess = pack(size_cc, clamp(n / 20.0, 1.0, 250.0), size_vol, F.greatest(size_cc / 4.0, F.lit(1.0)), rough, F.lit(0.0))
    return step.withColumn("m", F.when(large, guess).otherwise(exact) if guard else exact).drop("__code", "__tokens", "__words", "__h", "__x", "__cc", "__cog", "__dit")
