"""Full-text search: tokenizers, an inverted index as a DataFrame, boolean queries, BM25 and highlighting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.staging import staged

K1, B = 1.2, 0.75
LONGEST = 40


def tokenize(x: Column, tokenizer: str = "default") -> Column:
    """An array of tokens. default: lower case, at everything but letters and digits, up to 40 characters."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if tokenizer == "default":
        return F.filter(words, lambda t: F.char_length(t) <= LONGEST)
    if tokenizer == "simple":
        return words
    if tokenizer == "whitespace":
        return F.filter(F.split(x, r"\s+"), lambda t: t != "")
    if tokenizer == "raw":
        return F.array(x)
    if tokenizer == "ngram":
        low = F.lower(x)
        grams = lambda n: F.transform(F.when(F.char_length(low) >= n, F.sequence(F.lit(1), F.char_length(low) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(low, i, F.lit(n)))
        return F.concat(grams(2), grams(3))
    raise ValueError(f"no tokenizer {tokenizer}")


@dataclass(frozen=True)
class Term:
    """A word, prefix or phrase in one or all fields, with its boost."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Node:
    op: str  # "term", "and", "or", "not"
    parts: tuple = ()


LEX = re.compile(r'(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()":^]+))(?:\^(?P<boost>[\d.]+))?|(?P<open>\()|(?P<close>\))|\s+')


def parse(query: str) -> Node:
    """Terms are joined by OR; AND, NOT, brackets, "phrases", prefix*, field:term and term^boost."""
    items = []
    for m in LEX.finditer(query):
        if m["open"] or m["close"]:
            items.append(m[0])
        elif m["word"] in ("AND", "OR", "NOT") and not m["field"]:
            items.append(m["word"])
        elif m["word"] or m["phrase"] is not None:
            raw = m["phrase"] if m["phrase"] is not None else m["word"]
            prefix = m["phrase"] is None and raw.endswith("*")
            words = tuple(w for w in re.split(r"[\W_]+", raw.lower()) if w)
            if words:
                items.append(Node("term", (Term(words, prefix, m["field"], float(m["boost"] or 1)),)))
    at = 0

    def any_of() -> Node:
        nonlocal at
        parts = [all_of()]
        while at < len(items) and items[at] != ")":
            at += items[at] == "OR"
            parts.append(all_of())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def all_of() -> Node:
        nonlocal at
        parts = [one()]
        while at < len(items) and items[at] in ("AND", "NOT"):
            at += items[at] == "AND"
            parts.append(one())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def one() -> Node:
        nonlocal at
        if at >= len(items):
            raise ValueError("the query ends too early")
        item, at = items[at], at + 1
        if item == "NOT":
            return Node("not", (one(),))
        if item == "(":
            inner = any_of()
            if at >= len(items) or items[at] != ")":
                raise ValueError("a bracket is not closed")
            at += 1
            return inner
        if not isinstance(item, Node):
            raise ValueError(f"{item} stands alone")
        return item

    return any_of() if items else Node("or")


def terms(node: Node, positive: bool = True) -> list[Term]:
    if node.op == "term":
        return [node.parts[0]] if positive else []
    return [t for p in node.parts for t in terms(p, positive and node.op != "not")]


def holds(term: Term, tokens: dict[str, Column]) -> Column:
    """Whether a row has the term, over its token arrays by field."""
    out = F.lit(False)
    for field, array in tokens.items():
        if term.field in (None, field):
            if term.prefix:
                hit = F.exists(array, lambda t: t.startswith(term.words[0]))
            elif len(term.words) == 1:
                hit = F.array_contains(array, term.words[0])
            else:
                n = len(term.words)
                starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - (n - 1))).otherwise(F.array().cast("array<int>"))
                hit = F.exists(starts, lambda i: F.slice(array, i, F.lit(n)) == F.array(*map(F.lit, term.words)))
            out = out | hit
    return out


def match(node: Node, tokens: dict[str, Column]) -> Column:
    if node.op == "term":
        return holds(node.parts[0], tokens)
    if node.op == "not":
        return ~match(node.parts[0], tokens)
    out = F.lit(node.op == "and")
    for p in node.parts:
        out = (out & match(p, tokens)) if node.op == "and" else (out | match(p, tokens))
    return out


def fts_match(df: DataFrame, query: str, *fields: str, tokenizer: str = "default") -> DataFrame:
    """The rows that a boolean query holds for."""
    # Bound in an array of one, the tokens are made once a row, not once a use.
    row = F.array(F.struct(*(tokenize(F.coalesce(F.col(f), F.lit("")), tokenizer).alias(f) for f in fields)))
    return df.where(F.exists(row, lambda d: match(parse(query), {f: d[f] for f in fields})))


def tokens_sql(x: str) -> str:
    """``tokenize`` by default, as SQL text."""
    return f"filter(split(lower(coalesce({x}, '')), R'[^\\p{{L}}\\p{{N}}]+'), t -> t <> '' AND char_length(t) <= {LONGEST})"


def holds_sql(term: Term, arrays: dict[str, str]) -> str:
    quoted = [f"'{w}'" for w in term.words]
    out = []
    for a in (a for f, a in arrays.items() if term.field in (None, f)):
        if term.prefix:
            out.append(f"exists({a}, t -> startswith(t, {quoted[0]}))")
        elif len(quoted) == 1:
            out.append(f"array_contains({a}, {quoted[0]})")
        else:
            n = len(quoted)
            out.append(f"exists(CASE WHEN size({a}) >= {n} THEN sequence(1, size({a}) - {n - 1}) ELSE CAST(array() AS ARRAY<INT>) END, i -> slice({a}, i, {n}) = array({', '.join(quoted)}))")
    return f"({' OR '.join(out) or 'false'})"


def match_sql(query: str, *columns: str) -> str:
    """A boolean query over columns, as SQL text: words are letters and digits alone, so that no quote is in them."""
    names = [c.split(".")[-1].strip(" `") for c in columns]
    arrays = {n: f"d.`{n}`" for n in names}

    def text(node: Node) -> str:
        if node.op == "term":
            return holds_sql(node.parts[0], arrays)
        if node.op == "not":
            return f"(NOT {text(node.parts[0])})"
        return f"({f' {node.op.upper()} '.join(map(text, node.parts))})" if node.parts else "false"

    # Bound in an array of one, the tokens are made once a row, not once a use.
    row = ", ".join(f"{tokens_sql(c)} AS `{n}`" for c, n in zip(columns, names, strict=True))
    return f"exists(array(struct({row})), d -> {text(parse(query))})"


def highlight_sql(query: str, x: str, before: str, after: str) -> str:
    """``fts_highlight`` as SQL text; the marks are SQL expressions."""
    words = sorted({(w, t.prefix and w == t.words[-1]) for t in terms(parse(query)) for w in t.words})
    if not words:
        return x
    any_word = "|".join(w + (r"[\p{L}\p{N}]*" if p else "") for w, p in words)
    mark = lambda m: f"replace(replace({m}, R'\\', R'\\\\'), '$', R'\\$')"
    return f"regexp_replace({x}, R'(?iu)(?<![\\p{{L}}\\p{{N}}])({any_word})(?![\\p{{L}}\\p{{N}}])', concat({mark(before)}, '$1', {mark(after)}))"


def index(df: DataFrame, key: str, *fields: str, tokenizer: str = "default") -> DataFrame:
    """The inverted index: (field, term, key, tf, length), partial counts before the shuffle."""
    per_field = [df.select(F.lit(f).alias("field"), F.col(key), tokenize(F.coalesce(F.col(f), F.lit("")), tokenizer).alias("_t")) for f in fields]
    tokens = per_field[0]
    for more in per_field[1:]:
        tokens = tokens.union(more)
    exploded = tokens.withColumn("length", F.size("_t")).select("field", key, "length", F.explode("_t").alias("term"))
    return exploded.groupBy("field", "term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def fts_score(df: DataFrame, query: str, key: str, *fields: str, weights: dict[str, float] | None = None, tokenizer: str = "default") -> DataFrame:
    """(key, score): BM25 of the rows that match, over single words and phrases' words, weighted by field and boost.

    Only the query's terms are counted: one pass over the tokens, and sums by
    term that are as few as the terms.
    """
    node = parse(query)
    tokens = {f: tokenize(F.coalesce(F.col(f), F.lit("")), tokenizer) for f in fields}
    rows = df.select(key, *(t.alias(f"_{f}") for f, t in tokens.items()))
    wanted = [(f, w, t.prefix, t.boost * (weights or {}).get(f, 1.0)) for t in terms(node) for w in t.words for f in fields if t.field in (None, f)]
    tf = lambda f, w, prefix: F.size(F.filter(f"_{f}", (lambda t: t.startswith(w)) if prefix else (lambda t: t == w)))
    counted = rows.select(key, match(node, {f: F.col(f"_{f}") for f in fields}).alias("_hit"), *(F.size(f"_{f}").alias(f"_n_{f}") for f in fields), *(tf(f, w, p).alias(f"_tf{i}") for i, (f, w, p, _) in enumerate(wanted)))
    # Two numbers a field and one a term, read twice: the texts are tokenized once.
    counted = staged(counted)
    stats = counted.agg(F.count("*").alias("n"), *(F.avg(f"_n_{f}").alias(f"avg_{f}") for f in fields), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
    score = F.lit(0.0)
    for i, (f, _, _, weight) in enumerate(wanted):
        n, df_ = stats["n"], stats[f"df{i}"]
        idf = F.log(F.lit(1 + (n - df_ + 0.5) / (df_ + 0.5)))
        norm = K1 * (1 - B + B * F.col(f"_n_{f}") / (stats[f"avg_{f}"] or 1.0))
        score = score + weight * idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + norm)
    return counted.where("_hit").select(key, score.alias("score"))


def fts_highlight(x: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with the query's words marked, as whole words, without regard to case."""
    words = sorted({(w, t.prefix and w == t.words[-1]) for t in terms(parse(query)) for w in t.words})
    if not words:
        return x
    any_word = "|".join(re.escape(w) + (r"[\p{L}\p{N}]*" if p else "") for w, p in words)
    return F.regexp_replace(x, rf"(?iu)(?<![\p{{L}}\p{{N}}])({any_word})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}".replace("\\", "\\\\"))
