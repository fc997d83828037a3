"""Rewrites a query in the embedded-database dialect into Spark SQL text.

The text becomes tokens, nested by brackets. Function calls expand by the
macros of basalt.functions; operators whose meaning differs are rewritten;
compound selects become left-deep. Everything else passes as it is.
"""

from __future__ import annotations

import re

from basalt.functions import datetimes, macros, udfs  # noqa: F401  (they fill MACROS)
from basalt.functions.macros import MACROS, literal
from basalt.operators import fulltext

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<blob>[xX]'[0-9A-Fa-f]*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`|\[[A-Za-z_][^\]]*\](?=[\s,.)]|$))
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9A-Fa-f]+)|(?P<word>[A-Za-z_][A-Za-z_0-9$]*)
    |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|!=|==|@>|&&|::|[-+*/%&|~<>=(),.;:?\[\]{}])""",
    re.S | re.X,
)
TABLE_FUNCTIONS = {"generate_series", "json_each", "json_tree"}
Node = str | list  # a token, or a bracketed list of nodes with its brackets at the ends
#: Plain names of Spark that mean the same, so that they stay as they are.
KEEP = {"coalesce", "nullif", "count", "sum", "avg", "min", "max", "abs"}
#: Words after which an operand begins; they end an operand to their left.
WORDS = set("SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AND OR NOT IN IS LIKE GLOB REGEXP BETWEEN CASE WHEN THEN ELSE END AS ON USING JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL UNION ALL INTERSECT EXCEPT DISTINCT VALUES WITH RECURSIVE ASC DESC NULLS FIRST LAST OVER PARTITION ROWS RANGE GROUPS ESCAPE COLLATE FILTER WITHIN EXISTS ISNULL NOTNULL SET".split())
#: Functions over a window that take no notice of its frame.
FRAMELESS = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"}
AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg", "array_agg", "json_group_array", "jsonb_group_array", "json_group_object", "jsonb_group_object", "median", "percentile", "percentile_cont", "percentile_disc", "stddev", "mode", "max_by", "min_by", "any_value"}
CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT")
OPERATORS = set("+ - * / % | & << >> || < <= > >= = == <> != , -> ->>".split())


class Raw(str):
    """Spark text that stands as it is, as one token."""


class DialectError(ValueError):
    """The text cannot be read, or asks for what only a DataFrame operator does."""


def tokens(sql: str) -> list[str]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"cannot read {sql[at : at + 20]!r}")
        at = m.end()
        kind, word = m.lastgroup, m[0]
        if kind == "text":
            out.append(literal(word[1:-1].replace("''", "'")))
        elif kind == "blob":
            out.append("X" + word[1:])
        elif kind == "name":
            out.append("`" + word[1:-1].replace('""', '"') + "`")
        elif kind != "space":
            out.append(word)
    return out


def nest(words: list[str]) -> list[Node]:
    stack: list[list[Node]] = [[]]
    for w in words:
        if w == "(":
            stack.append(["("])
        elif w == ")":
            if len(stack) < 2:
                raise DialectError("a bracket closes that was not open")
            done = stack.pop() + [")"]
            stack[-1].append(done)
        else:
            stack[-1].append(w)
    if len(stack) > 1:
        raise DialectError("a bracket is not closed")
    return stack[0]


def upper(n: Node) -> str:
    return n.upper() if isinstance(n, str) else ""


def show(nodes: list[Node]) -> str:
    return " ".join(n if isinstance(n, str) else show(n) for n in nodes)


def split_by(nodes: list[Node], comma: str = ",") -> list[list[Node]]:
    out: list[list[Node]] = [[]]
    depth = 0  # of square brackets, which do not nest the nodes
    for n in nodes:
        depth += {"[": 1, "]": -1}.get(n, 0) if isinstance(n, str) else 0
        if n == comma and not depth:
            out.append([])
        else:
            out[-1].append(n)
    return out if out != [[]] else []


def is_operand(n: Node) -> bool:
    return isinstance(n, list) or (n not in OPERATORS and upper(n) not in WORDS and n not in (".", "::", ";"))


def clause(nodes: list[Node], start: int, word: str) -> int:
    """Where a clause of a SELECT begins, or its end."""
    return next((i for i in range(start, len(nodes)) if upper(nodes[i]) == word), len(nodes))


def within(nodes: list[Node], start: int, *words: str) -> int:
    """Where the first of some clauses begins, or the end."""
    return min(clause(nodes, start, w) for w in words)


class Suffix:
    """What may follow a call: WITHIN GROUP (..), FILTER (WHERE ..) and OVER .., as Spark text."""

    def __init__(self, rewriter: Rewriter, nodes: list[Node], at: int):
        self.within = self.filter = self.over = ""
        self.raw_over: Node = ""
        at_word = lambda k: upper(nodes[k]) if k < len(nodes) else ""
        if at_word(at) == "WITHIN" and at_word(at + 1) == "GROUP":
            self.within = show(rewriter.inner(nodes[at + 2])[1:-1])
            at += 3
        if at_word(at) == "FILTER" and isinstance(nodes[at + 1], list):
            self.filter = show(rewriter.block(nodes[at + 1][2:-1]))
            at += 2
        if at_word(at) == "OVER" and at + 1 < len(nodes):
            self.raw_over = nodes[at + 1]
            self.over = show(rewriter.inner(self.raw_over)) if isinstance(self.raw_over, list) else self.raw_over
            at += 2
        self.end = at

    def where(self, x: str) -> str:
        """An argument as it counts: Spark takes no FILTER over a window."""
        return f"CASE WHEN {self.filter} THEN {x} END" if self.filter and self.over else x

    def __str__(self) -> str:
        return (f" WITHIN GROUP ({self.within})" if self.within else "") + (f" FILTER (WHERE {self.filter})" if self.filter and not self.over else "") + (f" OVER {self.over}" if self.over else "")


class Rewriter:
    def __init__(self, bare: bool = False, integers: frozenset[str] = frozenset()):
        self.bare, self.integers = bare, integers

    def whole(self, text: str) -> bool:
        """Whether an operand is an integer for sure: of literals, known columns and counts, joined by + - *."""
        text = re.sub(r"^count *\([^()]*\) OVER \([^()]*\)$", "1", text)
        text = re.sub(r"\bcount *\( *(\*|[\w. `]*) *\)", "1", text)
        parts = re.findall(r"`?[A-Za-z_]\w*`?(?: *\. *`?[A-Za-z_]\w*`?)?|\d+|[-+*()]|\S", text)
        known = lambda p: p.isdigit() or p in "+-*()" or p.split(".")[-1].strip(" `").lower() in self.integers
        return all(map(known, parts)) and any(p not in "+-*()" for p in parts)

    def query(self, sql: str) -> str:
        nodes = nest(tokens(sql))
        while nodes and nodes[-1] == ";":
            nodes.pop()
        return show(self.block(nodes))

    def block(self, nodes: list[Node]) -> list[Node]:
        """A statement, an expression, or what stands between brackets."""
        nodes = self.compound(nodes)
        if upper(nodes[0] if nodes else "") in ("SELECT", "WITH"):
            nodes = self.frames(nodes)
            nodes = self.bare_columns(nodes) if self.bare else nodes
        return self.operators(self.limits(self.calls(nodes)))

    def inner(self, n: list) -> list:
        return ["(", *self.block(n[1:-1]), ")"]

    # Compounds bind from left to right with equal strength.
    def compound(self, nodes: list[Node]) -> list[Node]:
        at = [i for i, n in enumerate(nodes) if upper(n) in ("UNION", "INTERSECT", "EXCEPT")]
        if len(at) < 2 or all(upper(nodes[i]) == upper(nodes[at[0]]) for i in at):
            return nodes
        start = 0
        if upper(nodes[0]) == "WITH":
            start = next(i for i, n in enumerate(nodes) if upper(n) in ("SELECT", "VALUES"))
        tail = next((i for i in range(at[-1], len(nodes)) if upper(nodes[i]) in ("ORDER", "LIMIT")), len(nodes))
        left: list[Node] = nodes[start : at[0]]
        for i, j in zip(at, [*at[1:], tail], strict=True):
            k = i + 2 if upper(nodes[i + 1]) == "ALL" else i + 1
            left = ["(", *left, ")", *nodes[i:k], "(", *nodes[k:j], ")"]
            left = nest([*flat(left)])
        return [*nodes[:start], *left, *nodes[tail:]]

    # GROUPS bounds and EXCLUDE: a subquery ranks the rows, and frames go by those ranks.
    def frames(self, nodes: list[Node]) -> list[Node]:
        start = clause(nodes, 0, "SELECT")
        special = [i for i in range(start, len(nodes) - 1) if upper(nodes[i]) == "OVER" and isinstance(nodes[i + 1], list) and {"GROUPS", "EXCLUDE"} & set(map(upper, nodes[i + 1]))]
        if not special:
            return nodes
        begin = clause(nodes, start, "FROM")
        end = within(nodes, begin, "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT")
        source = nodes[begin + 1 : end]
        if any(upper(nodes[i]) in ("UNION", "INTERSECT", "EXCEPT", "GROUP", "WINDOW") for i in range(start, len(nodes))) or len(source) > 3 or "," in source or any(upper(n) == "JOIN" for n in source):
            raise DialectError("GROUPS and EXCLUDE: one source and no grouping; or use basalt.operators.windows")
        ranks, out, done = [], [], start
        for k, i in enumerate(special):
            call = i - 2
            condition: list[Node] = []
            if upper(nodes[call]) == "FILTER":
                condition, call = nodes[call + 1][2:-1], call - 2
            text, rank = self.framed(nodes[call], nodes[call + 1][1:-1], condition, nodes[i + 1][1:-1], k)
            ranks.append(rank)
            out += [*nodes[done:call], text]
            done = i + 2
        head = [*nodes[:start], *out, *nodes[done:begin]]
        hidden = ", ".join(f"_group{k}, _row{k}" for k in range(len(special)))
        head = [f"* EXCEPT ({hidden})" if n == "*" and (upper(head[j - 1]) == "SELECT" or head[j - 1] == ",") else n for j, n in enumerate(head)]
        tail = within(nodes, end, "ORDER", "LIMIT")
        name = next((n for n in reversed(source) if isinstance(n, str)), "_ranked")
        inner = ["(", "SELECT", "*", ",", Raw(", ".join(ranks)), "FROM", *source, *nodes[end:tail], ")"]
        return [*head, "FROM", inner, "AS", name, *nodes[tail:]]

    def framed(self, name: str, args: list[Node], condition: list[Node], window: list[Node], k: int) -> tuple[str, str]:
        """A call over a frame of GROUPS, or with EXCLUDE, as text over the ranks _group and _row; and the text of those."""
        frame = next(i for i, n in enumerate(window) if upper(n) in ("ROWS", "RANGE", "GROUPS"))
        exclude = next((i for i, n in enumerate(window) if upper(n) == "EXCLUDE"), len(window))
        order = clause(window, 0, "ORDER")
        partition = show(self.block(window[:order]))
        by, unit = show(self.block(window[order:frame])), upper(window[frame])
        bounds = show(window[frame + 1 : exclude])
        rank = f"dense_rank() OVER ({partition} {by}) AS _group{k}, row_number() OVER ({partition} {by}) AS _row{k}"
        key = {"GROUPS": f"ORDER BY _group{k} RANGE", "ROWS": f"ORDER BY _row{k} ROWS", "RANGE": f"{by} RANGE"}[unit]
        over = f"({partition} {key} {bounds})"
        kind, low = " ".join(map(upper, window[exclude + 1 :])), name.lower()
        x = show(self.block(args)) if args and args != ["*"] else "1"
        if condition:
            x = f"CASE WHEN {show(self.block(condition))} THEN {x} END"
        if kind in ("", "NO OTHERS"):
            call = f"coalesce(sum(CAST({x} AS DOUBLE)) OVER {over}, 0.0D)" if low == "total" else f"{name}({x}) OVER {over}"
            return call, rank
        kept = {"CURRENT ROW": f"e.r <> _row{k}", "GROUP": f"e.g <> _group{k}", "TIES": f"(e.g <> _group{k} OR e.r = _row{k})"}[kind]
        rows = f"filter(collect_list(struct(_row{k} AS r, _group{k} AS g, {x} AS x)) OVER {over}, e -> {kept})"
        values = f"transform(filter({rows}, e -> e.x IS NOT NULL), e -> e.x)"
        sum_ = f"CASE WHEN size({values}) > 0 THEN aggregate(slice({values}, 2, size({values})), {values}[0], (a, b) -> a + b) END"
        calls = {
            "count": f"size({values})", "min": f"array_min({values})", "max": f"array_max({values})", "sum": sum_,
            "total": f"coalesce(CAST({sum_} AS DOUBLE), 0.0D)", "avg": f"CAST({sum_} AS DOUBLE) / size({values})",
            "first_value": f"get({rows}, 0).x", "last_value": f"try_element_at({rows}, -1).x", "group_concat": f"CASE WHEN size({values}) > 0 THEN array_join(transform({values}, v -> CAST(v AS STRING)), ',') END",
        }
        if low not in calls:
            raise DialectError(f"EXCLUDE: {name} is not carried over")
        return calls[low], rank

    # Columns that are neither grouped nor aggregated come from the row of the one max or min, else from any row.
    def bare_columns(self, nodes: list[Node]) -> list[Node]:
        start = clause(nodes, 0, "SELECT")
        end, group = within(nodes, start, *CLAUSES), clause(nodes, start, "GROUP")
        if any(upper(n) in ("UNION", "INTERSECT", "EXCEPT") for n in nodes[start:]):
            return nodes
        items = split_by(nodes[start + 1 : end])
        keys = split_by(nodes[group + 2 : within(nodes, group, "HAVING", "WINDOW", "ORDER", "LIMIT")]) if group < len(nodes) else []
        texts = {show(k).lower() for k in keys}
        names = {n.strip("`").lower() for k in keys for n in flat(k) if re.fullmatch(r"`?[A-Za-z_]\w*`?", n)}
        calls = lambda item: [(item[i].lower(), item[i + 1]) for i in range(len(item) - 1) if isinstance(item[i], str) and item[i].lower() in AGGREGATES and isinstance(item[i + 1], list)]
        extremes = [c for item in items for c in calls(item) if c[0] in ("max", "min") and "," not in c[1]]
        out: list[Node] = []
        for k, item in enumerate(items):
            at = clause(item, 0, "AS")
            expr, alias = item[:at], item[at + 1 :]
            used = {n.strip("`").lower() for j, n in enumerate(expr) if isinstance(n, str) and re.fullmatch(r"`?[A-Za-z_]\w*`?", n) and upper(n) not in WORDS and not (j + 1 < len(expr) and isinstance(expr[j + 1], list))}
            plain = not any(isinstance(n, list) for n in expr)
            if calls(expr) or not used or (plain and used <= names) or show(expr).lower() in texts or str(k + 1) in texts or (alias and alias[0].lower() in texts):
                new = item
            else:
                pick = ["max_by" if extremes[0][0] == "max" else "min_by", ["(", *expr, ",", *extremes[0][1][1:-1], ")"]] if len(extremes) == 1 else ["any_value", ["(", *expr, ")"]]
                new = [*pick, "AS", *(alias or [expr[-1] if isinstance(expr[-1], str) else f"`{show(expr)}`"])]
            out += [",", *new] if out else new
        return [*nodes[: start + 1], *out, *nodes[end:]]

    # A negative limit is none, a negative offset 0; LIMIT a, b is LIMIT b OFFSET a.
    def limits(self, nodes: list[Node]) -> list[Node]:
        out, i = [], 0
        while i < len(nodes):
            if upper(nodes[i]) == "LIMIT" and i + 2 < len(nodes) and nodes[i + 1] == "-":
                i += 3
            elif upper(nodes[i]) == "OFFSET" and i + 2 < len(nodes) and nodes[i + 1] == "-":
                i += 3
            elif upper(nodes[i]) == "LIMIT" and i + 3 < len(nodes) and nodes[i + 2] == ",":
                out += ["LIMIT", nodes[i + 3], "OFFSET", nodes[i + 1]]
                i += 4
            else:
                out.append(nodes[i])
                i += 1
        return out

    def calls(self, nodes: list[Node]) -> list[Node]:
        out, i = [], 0
        while i < len(nodes):
            n, after = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else ""
            if isinstance(n, str) and isinstance(after, list) and re.fullmatch(r"[A-Za-z_]\w*", n) and (upper(n) not in WORDS or self.as_function(n, out)):
                before = nodes[i - 1] if i else ""
                if n.lower() in TABLE_FUNCTIONS and (upper(before) in ("FROM", "JOIN") or before == ","):
                    out += self.table_function(n, after, before)
                elif upper(nodes[i - 1] if i else "") in ("TABLE", "INTO", "WITH", "RECURSIVE") or self.starts_cte(nodes, i):
                    out += [n, self.inner(after)]  # a table with a column list
                else:
                    suffix = Suffix(self, nodes, i + 2)
                    out += self.call(n, after, suffix)
                    i = suffix.end - 2
                i += 2
            elif isinstance(n, list):
                out.append(self.inner(n))
                i += 1
            else:
                out.append(n)
                i += 1
        return out

    @staticmethod
    def starts_cte(nodes: list[Node], i: int) -> bool:
        """``, name (columns) AS (SELECT ...``"""
        body = nodes[i + 3] if i + 3 < len(nodes) else ""
        if isinstance(body, str) and upper(body) in ("NOT", "MATERIALIZED"):
            return True
        return bool(i) and nodes[i - 1] == "," and upper(nodes[i + 2] if i + 2 < len(nodes) else "") == "AS" and isinstance(body, list) and upper(body[1]) in ("SELECT", "WITH", "VALUES")

    @staticmethod
    def as_function(name: str, out: list[Node]) -> bool:
        """like(p, x) and its kin are calls where no operand stands before them."""
        return name.upper() in ("LIKE", "GLOB", "REGEXP") and not (out and (is_operand(out[-1]) or upper(out[-1]) == "NOT"))

    def table_function(self, name: str, bracket: list, before: Node) -> list[Node]:
        """generate_series, json_each and json_tree where a table stands."""
        args = [show(self.block(a)) for a in split_by(bracket[1:-1])]
        lateral = ["LATERAL"] if before == "," or upper(before) == "JOIN" else []
        if name.lower() != "generate_series":
            return [*lateral, f"{name.lower()}({', '.join(args)})"]
        start, stop, step = (*args, str((1 << 32) - 1), "1")[:3] if len(args) == 1 else (*args, "1")[:3]
        step = f"(CASE WHEN ({step}) = 0 THEN 1 ELSE ({step}) END)"
        rows = f"sequence(CAST({start} AS BIGINT), CAST({stop} AS BIGINT), CAST({step} AS BIGINT))"
        right = f"(({step} > 0 AND {start} <= {stop}) OR ({step} < 0 AND {start} >= {stop}))"
        return [*lateral, f"(SELECT explode(CASE WHEN {right} THEN {rows} ELSE CAST(array() AS ARRAY<BIGINT>) END) AS value)"]

    def call(self, name: str, bracket: list, after: Suffix) -> list[Node]:
        low = name.lower()
        if low == "cast":
            return self.cast(bracket)
        body = bracket[1:-1]
        distinct = bool(body) and upper(body[0]) == "DISTINCT"
        order = clause(body, 0, "ORDER") if low in AGGREGATES else len(body)
        by = show(self.block(body[order:]))
        args = [self.block(a) for a in split_by(body[distinct:order])]
        texts = [show(a) for a in args]
        if low in AGGREGATES and texts and texts[0] != "*":
            texts[0] = after.where(texts[0])
        only = "DISTINCT " if distinct else ""
        if low in ("group_concat", "string_agg"):
            sep = texts[1] if len(texts) > 1 else literal(",")
            if after.over:
                # Spark's own takes no window's order.
                return [f"CASE WHEN count({texts[0]}) {after} > 0 THEN array_join(transform(collect_list(CAST({texts[0]} AS STRING)) {after}, x -> x), {sep}) END"]
            return [f"listagg({only}CAST({texts[0]} AS STRING), {sep})" + (f" WITHIN GROUP ({by})" if by else "") + str(after)]
        if low == "total":
            return [f"coalesce(sum({only}CAST({texts[0]} AS DOUBLE)){after}, 0.0D)"]
        if low in ("array_agg", "json_group_array", "jsonb_group_array"):
            # All values with their order, then the values alone; a FILTER before a window stands in a condition of its own.
            keys = [show(self.block(k)) for k in split_by(body[order + 2 :])]
            downs = [k.upper().endswith(" DESC") for k in keys]
            fields = ", ".join(f"{re.sub('(?i) (ASC|DESC)$', '', k)} AS k{i}" for i, k in enumerate(keys))
            entry = f"struct({fields + ', ' if fields else ''}{show(args[0])} AS x)"
            rows = f"collect_{'set' if distinct else 'list'}({after.where(entry)}){after}"
            if keys:
                rows = f"sort_array({rows}, {'false' if all(downs) else 'true'})"
                if any(downs) and not all(downs):
                    raise DialectError("ORDER BY within an aggregate: one direction")
            values = f"transform({rows}, s -> s.x)"
            return [values if low == "array_agg" else f"to_json({values}, map('ignoreNullFields', 'false'))"]
        if low in ("json_group_object", "jsonb_group_object"):
            pair = f"concat(to_json(CAST({show(args[0])} AS STRING)), ':', coalesce(to_json({texts[1]}), 'null'))"
            return [f"concat('{{', array_join(collect_list({after.where(pair)}){after}, ','), '}}')"]
        if low == "count" and (not texts or texts == ["*"]):
            return [f"count({after.where('1') if after.filter and after.over else '*'}){after}"]
        if low in ("fts_match", "fts_highlight"):
            if not re.fullmatch(r"'.*'", texts[-1], re.S):
                raise DialectError(f"{name}: the query is a literal")
            query = texts[-1][1:-1].replace("\\'", "'").replace("\\\\", "\\")
            if low == "fts_match":
                return [fulltext.match_sql(query, *texts[:-1])]
            marked = [fulltext.highlight_sql(query, x, texts[-3], texts[-2]) for x in texts[:-3]]
            return [marked[0] if len(marked) == 1 else f"concat_ws(' ', {', '.join(marked)})"]
        if low == "stddev":
            return [f"stddev_samp({only}{texts[0]}){after}"]
        if low == "percentile":
            return [f"percentile({texts[0]}, ({texts[1]}) / 100){after}"]
        if low == "percentile_cont" and len(texts) == 2:
            return [f"percentile({texts[0]}, {texts[1]}){after}"]
        if low == "percentile_disc" and len(texts) == 2:
            return [f"element_at(sort_array(collect_list({texts[0]}){after}), CAST(floor({texts[1]} * (count({texts[0]}){after} - 1)) AS INT) + 1)"]
        if low in ("min", "max") and len(texts) > 1:
            return [macros.expand("scalar_" + low, *texts)]
        if low in FRAMELESS and isinstance(after.raw_over, list):
            over = after.raw_over
            cut = next((i for i, n in enumerate(over) if upper(n) in ("ROWS", "RANGE", "GROUPS")), len(over) - 1)
            after.over = show(self.inner([*over[:cut], ")"]))
        if low in MACROS and low not in KEEP:
            return [macros.expand(low, *texts) + str(after)]
        call = ["(", *([only] if only else []), *(_joined([[t] for t in texts]) if after.filter and after.over else _joined(args)), *([by] if by else []), ")"]
        # With what follows it a call is one operand.
        return [show([name, call]) + str(after)] if str(after) else [name, call]

    def cast(self, bracket: list) -> list[Node]:
        at = next(i for i, n in enumerate(bracket) if upper(n) == "AS")
        what, kind = show(self.block(bracket[1:at])), show(bracket[at + 1 : -1]).upper()
        if "INT" in kind:
            return [macros.expand("cast_integer", what)]
        if any(k in kind for k in ("REAL", "FLOA", "DOUB")):
            return [macros.expand("cast_real", what)]
        if any(k in kind for k in ("CHAR", "CLOB", "TEXT")):
            return [macros.expand("cast_text", what)]
        if kind == "NUMERIC":
            return [macros.expand("cast_numeric", what)]
        return [f"CAST({what} AS {'BINARY' if kind == 'BLOB' else kind})"]

    def operators(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0

        def left() -> str:
            """Take the operand that ends what is written so far: a name with its dots, a literal, or brackets."""
            j = len(out) - 1
            if j < 0 or not is_operand(out[j]):
                raise DialectError("an operator lacks its left side")
            while j >= 2 and out[j - 1] == ".":
                j -= 2
            if j >= 1 and isinstance(out[j], list) and isinstance(out[j - 1], str) and is_operand(out[j - 1]) and re.fullmatch(r"\w+", out[j - 1]):
                j -= 1  # the call's name
            while j >= 1 and out[j - 1] in ("-", "+", "~") and (j == 1 or not is_operand(out[j - 2])):
                j -= 1  # signs bind tighter
            found = show(out[j:])
            del out[j:]
            return found

        def right() -> str:
            """Read the operand that comes next."""
            nonlocal i
            sign = ""
            while nodes[i] in ("-", "+", "~"):
                sign += nodes[i]
                i += 1
            j = i + 1
            if j < len(nodes) and isinstance(nodes[j], list) and isinstance(nodes[i], str) and re.fullmatch(r"\w+", nodes[i]):
                j += 1
            while j + 1 < len(nodes) and nodes[j] == ".":
                j += 2
            found, i = sign + show(nodes[i:j]), j
            return found

        def product() -> str:
            """The operand to the left with the factors before it: a * b / c is (a * b) / c."""
            found = left()
            while len(out) > 1 and out[-1] == "*" and is_operand(out[-2]):
                out.pop()
                found = f"{left()} * {found}"
            return found if " * " not in found else f"({found})"

        while i < len(nodes):
            n, word = nodes[i], upper(nodes[i])
            i += 1
            if n == "==":
                out.append("=")
            elif n == "/":
                x, y = product(), right()
                out.append(f"(CASE WHEN ({y}) <> 0 THEN ({x}) div ({y}) END)" if self.whole(x) and self.whole(y) else macros.expand("divide", x, y))
            elif n == "%":
                out.append(macros.expand("int_mod", product(), right()))
            elif n in ("<<", ">>"):
                out.append(macros.expand("shift_left" if n == "<<" else "shift_right", left(), right()))
            elif n in ("->", "->>"):
                # Inside a lambda of an expanded macro no bare arrow is left: those are text already.
                out.append(macros.expand("json_arrow" if n == "->" else "json_arrow_text", left(), right()))
            elif n == "@>":
                out.append(macros.expand("array_contains_all", left(), right()))
            elif n == "&&":
                out.append(macros.expand("array_overlap", left(), right()))
            elif n == "::":
                what = left()
                out += self.cast(["(", what, "AS", right(), ")"])
            elif word == "ISNULL":
                out += ["IS", "NULL"]
            elif word == "NOTNULL" or (word == "NOT" and i < len(nodes) and upper(nodes[i]) == "NULL"):
                i += word == "NOT"
                out += ["IS", "NOT", "NULL"]
            elif word in ("LIKE", "GLOB", "REGEXP"):
                flip = bool(out) and upper(out[-1]) == "NOT"
                if flip:
                    out.pop()
                x, pattern, escape = left(), right(), []
                if i < len(nodes) and upper(nodes[i]) == "ESCAPE":
                    i += 1
                    escape = [right()]
                test = f"({macros.expand(word.lower(), pattern, x, *escape)} = 1)"
                out.append(f"(NOT {test})" if flip else test)
            elif word == "IS" and i < len(nodes):
                no = upper(nodes[i]) == "NOT"
                j = i + no
                if upper(nodes[j]) in ("NULL", "DISTINCT"):
                    out.append(n)
                elif upper(nodes[j]) in ("TRUE", "FALSE"):
                    test = f"{macros.expand('is_' + nodes[j].lower(), left())} = {int(not no)}"
                    out.append(f"({test})")
                    i = j + 1
                else:
                    i = j
                    x = left()
                    out.append(f"({'NOT ' if no else ''}{x} <=> {right()})")
            elif n == "[":
                depth, j = 1, i
                while depth:
                    depth += {"[": 1, "]": -1}.get(nodes[j] if isinstance(nodes[j], str) else "", 0)
                    j += 1
                parts = [show(self.operators(p)) for p in split_by(nodes[i : j - 1], ":" if out and upper(out[-1]) != "ARRAY" else ",")]
                i = j
                if out and upper(out[-1]) == "ARRAY":
                    out[-1] = f"array({', '.join(parts)})"
                else:
                    x = left()
                    out.append(macros.expand("array_element", x, *parts) if len(parts) == 1 else macros.expand("array_slice", x, parts[0] or "0", parts[1] or f"size({x})"))
            elif word == "EXCLUDE" or (word == "GROUPS" and i < len(nodes) and upper(nodes[i]) in ("BETWEEN", "UNBOUNDED", "CURRENT")):
                raise DialectError("GROUPS and EXCLUDE stand in a call's own OVER (..); or use basalt.operators.windows")
            elif word == "COLLATE" and i < len(nodes):
                names = {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY", "RTRIM": "UTF8_BINARY_RTRIM"}
                out += ["COLLATE", names.get(upper(nodes[i]), nodes[i])]
                i += 1
            elif word in ("MATERIALIZED",) or (word == "NOT" and i < len(nodes) and upper(nodes[i]) == "MATERIALIZED"):
                i += word == "NOT"  # hints: results are the same
            else:
                out.append(n)
        return out


def flat(nodes: list[Node]):
    for n in nodes:
        if isinstance(n, list):
            yield from flat(n)
        else:
            yield n


def _joined(args: list[list[Node]]) -> list[Node]:
    out: list[Node] = []
    for a in args:
        out += [",", *a] if out else a
    return out


def rewrite(sql: str, bare: bool = False, integers: frozenset[str] = frozenset()) -> str:
    """``integers`` names columns that are whole numbers wherever they are known: their quotients are whole too."""
    return Rewriter(bare, integers).query(sql)
