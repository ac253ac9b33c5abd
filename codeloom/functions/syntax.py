"""Syntax-level features of Python snippets: one parse per snippet, in Arrow batches.

Snippets are parsed, never run. Within a batch equal snippets are parsed once. A snippet that
does not parse, is null, or nests too deeply for the parser has ``valid`` false and zeros.
"""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text

LOOPS = (ast.For, ast.AsyncFor, ast.While)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
# Names whose use the security check reports.
RISKY_MODULES = frozenset("os subprocess eval importlib sys socket urllib requests http".split())
RISKY_CALLS = frozenset("eval exec compile __import__ open file input raw_input".split())
RISKY_ATTRIBUTES = frozenset("__globals__ __locals__ __builtins__ __code__ __func__ __self__".split())
LIST_METHODS = frozenset("append extend insert remove pop sort reverse".split())

NUMBERS = (
    "loop_depth n_loops n_sibling_loops most_inner_loops n_functions n_classes n_ifs n_comprehensions n_calls n_assigns "
    "n_list_calls n_returns n_breaks n_slices n_tries n_recursive_calls n_nodes body_depth return_in_loop equality sum_call "
    "max_call names_target uses_dict uses_set uses_list uses_tuple uses_sorting n_builtin_calls range_loops enumerate_loops "
    "n_for n_while n_break n_continue n_plain_assigns n_names n_list_calls5 n_list_calls4 has_builtin uses_slicing n_list_comps n_dict_comps "
    "n_set_comps n_generators control_depth self_calls n_multi_recursive has_base_case fibonacci_recursion fibonacci_name binary_search "
    "divides halves loop_run direct_depth first_recursive loop_pairs"
).split()


def parse(code: str | None) -> ast.Module | None:
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _body_depth(node: ast.AST) -> int:
    inner = [_body_depth(x) for x in getattr(node, "body", []) if isinstance(x, ast.AST)] if isinstance(getattr(node, "body", None), list) else []
    return 1 + max(inner) if inner else 0


def numbers(tree: ast.Module) -> dict[str, int]:
    """The NUMBERS of a parsed snippet, by one walk that carries loop depth and function."""
    out = Counter()
    todo: list[tuple[ast.AST, int, str | None]] = [(tree, 0, None)]
    while todo:
        node, depth, function = todo.pop()
        out["n_nodes"] += 1
        if isinstance(node, LOOPS):
            depth += 1
            out["n_loops"] += 1
            out["n_sibling_loops"] += depth == 1
            out["loop_depth"] = max(out["loop_depth"], depth)
            out["most_inner_loops"] = max(out["most_inner_loops"], sum(isinstance(x, LOOPS) for x in ast.walk(node)) - 1)
            if isinstance(node, ast.For) and isinstance(node.iter, ast.Call) and isinstance(node.iter.func, ast.Name):
                out["range_loops"] += node.iter.func.id == "range"
                out["enumerate_loops"] += node.iter.func.id == "enumerate"
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["n_functions"] += 1
            function = node.name
        elif isinstance(node, ast.Call):
            out["n_calls"] += 1
            if isinstance(node.func, ast.Name):
                name = node.func.id
                out["n_recursive_calls"] += name == function
                out["sum_call"] |= name == "sum"
                out["max_call"] |= name == "max"
                out["uses_sorting"] |= name == "sorted"
                out["uses_set"] |= name == "set"
                out["has_builtin"] |= name in ("sum", "max", "min", "len", "sorted", "enumerate")
                out["n_builtin_calls"] += name in ("len", "max", "min", "sum", "sorted", "abs", "any", "all", "range", "enumerate", "zip")
            elif isinstance(node.func, ast.Attribute):
                out["n_list_calls"] += node.func.attr in LIST_METHODS
                out["n_list_calls5"] += node.func.attr in ("append", "extend", "insert", "remove", "pop")
                out["n_list_calls4"] += node.func.attr in ("append", "extend", "insert", "remove")
                out["uses_sorting"] |= node.func.attr == "sort"
        elif isinstance(node, ast.Return):
            out["n_returns"] += 1
            out["return_in_loop"] |= depth > 0
        elif isinstance(node, ast.Compare):
            out["equality"] |= any(isinstance(op, ast.Eq) for op in node.ops)
        elif isinstance(node, ast.Name):
            out["names_target"] |= node.id == "target"
        for name in _COUNTS_OF.get(type(node), ()):
            out[name] += 1
        todo.extend((x, depth, function) for x in ast.iter_child_nodes(node))
    out["body_depth"] = _body_depth(tree)
    for name in (*_FLAGGED.values(), "uses_set"):
        out[name] = min(out[name], 1)
    out.update(more_numbers(tree))
    return {name: int(out[name]) for name in NUMBERS}


def _counts_of() -> dict[type, list[str]]:
    """The NUMBERS that a node of each type adds one to."""
    kinds = {
        "n_classes": [ast.ClassDef], "n_ifs": [ast.If], "n_comprehensions": COMPREHENSIONS, "n_assigns": [ast.Assign, ast.AugAssign, ast.AnnAssign],
        "n_breaks": [ast.Break, ast.Continue], "n_slices": [ast.Slice], "n_tries": [ast.Try], "n_for": [ast.For], "n_while": [ast.While],
        "n_break": [ast.Break], "n_continue": [ast.Continue], "n_plain_assigns": [ast.Assign], "n_names": [ast.Name], "n_list_comps": [ast.ListComp],
        "n_dict_comps": [ast.DictComp], "n_set_comps": [ast.SetComp], "n_generators": [ast.GeneratorExp],
        **{name: [kind] for kind, name in _FLAGGED.items()},
    }
    out: dict[type, list[str]] = {}
    for name, own in kinds.items():
        for kind in own:
            out.setdefault(kind, []).append(name)
    return out


_FLAGGED = {ast.Dict: "uses_dict", ast.Set: "uses_set", ast.List: "uses_list", ast.Tuple: "uses_tuple"}
_COUNTS_OF = _counts_of()


def _depth_below(node: ast.AST, kinds: tuple[type, ...], depth: int = 0) -> int:
    """Greatest number of nodes of the kinds on a path down from ``node``, without itself."""
    most, todo = depth, [(node, depth)]
    while todo:
        at, own = todo.pop()
        for x in ast.iter_child_nodes(at):
            below = own + isinstance(x, kinds)
            most = max(most, below)
            todo.append((x, below))
    return most


def _direct_depth(loop: ast.AST) -> int:
    """Loops that stand directly in the body of one another, this one included."""
    return 1 + max((_direct_depth(x) for x in ast.iter_child_nodes(loop) if isinstance(x, LOOPS)), default=0)


def _halves_interval(loop: ast.While) -> bool:
    """A while loop that sets ``mid`` by a floor division and compares by ``<=``."""
    sets_mid = any(
        isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name) and x.targets[0].id == "mid"
        and any(isinstance(y, ast.BinOp) and isinstance(y.op, ast.FloorDiv) for y in ast.walk(x.value))
        for x in ast.walk(loop)
    )
    return sets_mid and any(isinstance(x, ast.Compare) and isinstance(x.ops[0], ast.LtE) for x in ast.walk(loop))


def more_numbers(tree: ast.Module) -> dict[str, int]:
    """The NUMBERS that need another view of the tree: per function, per loop, by level."""
    out = Counter(control_depth=_depth_below(tree, (ast.For, ast.While, ast.If, ast.FunctionDef, ast.ClassDef)))
    run, first, whole = 0, None, list(ast.walk(tree))
    for node in whole:  # level by level
        kind = type(node)
        if kind is ast.For or kind is ast.While:
            run += 1
            inner = list(ast.walk(node))
            out["loop_run"] = max(out["loop_run"], run)
            out["direct_depth"] = max(out["direct_depth"], _direct_depth(node))
            out["loop_pairs"] += sum(type(x) is ast.For or type(x) is ast.While for x in inner) - 1
            if kind is ast.While:
                out["binary_search"] |= _halves_interval(node)
            elif any(type(x) is ast.Slice for x in ast.walk(node.iter)) and any(type(x) is ast.Call for x in inner):
                out["divides"] = 1
        elif kind is ast.FunctionDef:
            run, inner = 0, list(ast.walk(node))
            calls = [x for x in inner if type(x) is ast.Call and type(x.func) is ast.Name and x.func.id == node.name]
            first = first or node.name
            out["self_calls"] += len(calls)
            out["n_multi_recursive"] += len(calls) > 1
            named = "fibonacci" in node.name.lower()
            out["fibonacci_name"] |= named
            out["fibonacci_recursion"] |= named and len(calls) > 0
            if calls:
                out["has_base_case"] |= any(type(x) is ast.If and any(type(y) is ast.Return for y in ast.walk(x)) for x in inner)
                out["divides"] |= any(type(a) is ast.BinOp and type(a.op) is ast.Div for x in calls for a in x.args)
            out["halves"] += sum(type(x) is ast.BinOp and type(x.op) in (ast.Div, ast.FloorDiv) or type(x) is ast.Subscript and type(x.slice) is ast.Slice for x in inner)
        elif kind is ast.Subscript:
            out["uses_slicing"] |= type(node.slice) is ast.Slice
    out["first_recursive"] = first is not None and any(type(x) is ast.Call and type(x.func) is ast.Name and x.func.id == first for x in whole)
    return out


def symbols(tree: ast.Module) -> list[dict]:
    """Names that are read and constants, with their numbers."""
    read = Counter(x.id for x in ast.walk(tree) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load))
    fixed = Counter(repr(x.value) for x in ast.walk(tree) if isinstance(x, ast.Constant))
    return [{"kind": kind, "value": v, "n": n} for kind, own in (("name", read), ("constant", fixed)) for v, n in sorted(own.items())]


def token_types(code: str | None) -> list[dict]:
    """(type, n) of the lexical tokens; nothing for a text that does not tokenize."""
    kinds = Counter(tokenize.tok_name[t.type] for t in _tokens(code))
    return [{"type": k, "n": n} for k, n in sorted(kinds.items())]


def _tokens(code: str | None) -> list[tokenize.TokenInfo]:
    try:
        return list(tokenize.tokenize(io.BytesIO((code or "").encode()).readline)) if code else []
    except (tokenize.TokenError, SyntaxError, ValueError):
        return []


# Operators that the token features count.
OPERATORS = frozenset("+ - * / % == != > < >= <= and or not".split())
_LAYOUT = frozenset((tokenize.COMMENT, tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT))
TOKENS = "n_tokens int, n_unique int, mean_length double, n_operators int, n_comments int, n_name_tokens int, n_op_tokens int, n_number_tokens int"


def token_numbers(code: str | None) -> list[dict]:
    """TOKENS of a snippet without comments and layout; zeros where it does not tokenize."""
    every = _tokens(code)
    own = [t.string for t in every if t.type not in _LAYOUT]
    kinds = Counter(t.type for t in every)
    return [
        {
            "n_tokens": len(own), "n_unique": len(set(own)), "mean_length": sum(map(len, own)) / max(1, len(own)),
            "n_operators": sum(x in OPERATORS for x in own), "n_comments": sum((code or "").count(x) for x in ("#", '"""', "'''")),
            "n_name_tokens": kinds[tokenize.NAME], "n_op_tokens": kinds[tokenize.OP], "n_number_tokens": kinds[tokenize.NUMBER],
        }
    ]


def defined_functions(tree: ast.Module) -> list[dict]:
    return [
        {
            "name": f.name,
            "n_args": len(f.args.posonlyargs) + len(f.args.args) + len(f.args.kwonlyargs),
            "first_line": f.lineno,
            "last_line": f.end_lineno,
            "has_return": any(isinstance(x, ast.Return) for x in ast.walk(f)),
        }
        for f in ast.walk(tree)
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))
    ]


def risks(code: str | None) -> list[dict]:
    """Risky imports and attributes (high), risky calls (critical), or that it does not parse."""
    tree = parse(code)
    if tree is None:
        return [] if code is None else [{"severity": "medium", "what": "syntax error", "line": None}]
    out = []
    for node in ast.walk(tree):
        found: list[tuple[str, str]] = []
        if isinstance(node, ast.Import):
            found = [("high", f"import {a.name}") for a in node.names if a.name.split(".")[0] in RISKY_MODULES]
        elif isinstance(node, ast.ImportFrom) and (node.module or "").split(".")[0] in RISKY_MODULES:
            found = [("high", f"import {node.module}")]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in RISKY_CALLS:
            found = [("critical", f"call {node.func.id}")]
        elif isinstance(node, ast.Attribute) and node.attr in RISKY_ATTRIBUTES:
            found = [("high", f"attribute {node.attr}")]
        out += [{"severity": s, "what": w, "line": node.lineno} for s, w in found]
    return out


def node_counts(tree: ast.Module) -> list[dict]:
    return [{"node": k, "n": n} for k, n in sorted(Counter(type(x).__name__ for x in ast.walk(tree)).items())]


def per_snippet(df: DataFrame, key: str, code: str, schema: str, judge: Callable[[str | None], list[dict]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, *schema): the rows that ``judge`` gives for each snippet, each text judged once a batch.

    Columns in ``keep`` pass through with their row, so nothing has to be joined back. The rows are
    dealt out evenly first: parsing costs far more than moving code once, and one compressed split can
    hold very many snippets.
    """
    kept = df.select(key, *keep).schema
    target = T.StructType([*kept.fields, *df.sparkSession.createDataFrame([], schema).schema.fields])
    names = target.names[len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(T.StructType(target.fields[len(kept) :]))
        for batch in batches:
            cache: dict[str | None, list[dict]] = {}
            at, rows = [], []
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                if text not in cache:
                    cache[text] = judge(text)
                at += [i] * len(cache[text])
                rows += cache[text]
            own = pa.Table.from_pylist(rows, shape).combine_chunks()
            made = [own.column(n).combine_chunks() if own.num_rows else pa.array([], shape.field(n).type) for n in names]
            passed = batch.take(pa.array(at, pa.int64())).columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*passed, *made], names=target.names)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, *keep, F.col(code).alias("_code")).repartition(parts).mapInArrow(run, target)


def _features_row(code: str | None) -> list[dict]:
    tree = parse(code)
    try:
        own = numbers(tree) if tree else dict.fromkeys(NUMBERS, 0)
    except RecursionError:
        tree, own = None, dict.fromkeys(NUMBERS, 0)
    return [{"valid": tree is not None, **own}]


def features(df: DataFrame, key: str, code: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return per_snippet(df, key, code, "valid boolean, " + ", ".join(f"{n} int" for n in NUMBERS), _features_row, keep)


def validity(df: DataFrame, key: str, code: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return per_snippet(df, key, code, f"{name} boolean", lambda x: [{name: parse(x) is not None}], keep)


def functions(df: DataFrame, key: str, code: str) -> DataFrame:
    schema = "name string, n_args int, first_line int, last_line int, has_return boolean"
    return per_snippet(df, key, code, schema, lambda x: defined_functions(t) if (t := parse(x)) else [])


def security(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, "severity string, what string, line int", risks)


def nodes(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, "node string, n int", lambda x: node_counts(t) if (t := parse(x)) else [])


def tokens(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, TOKENS, token_numbers)


def token_counts(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, "type string, n int", token_types)


def symbols_used(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, "kind string, value string, n int", lambda x: symbols(t) if (t := parse(x)) else [])


def complexities(code: Column) -> dict[str, Column]:
    """The complexity estimators that differ, as columns over features and the text."""
    low, depth = F.lower(code), F.col("loop_depth")
    recursive = F.col("n_recursive_calls")
    by_depth = F.when(depth >= 3, "O(n³)").when(depth == 2, "O(n²)")
    return {
        "by_depth": F.when(~F.col("valid"), "Unknown").otherwise(
            by_depth.when((depth == 1) & low.contains("sort"), "O(n log n)").when(depth == 1, "O(n)").otherwise("O(1)")
        ),
        "space": F.when(~F.col("valid"), "Unknown").when(
            code.contains("dict") | code.contains("set") | code.contains("{}"), "O(n)"
        ).otherwise("O(1)"),
        "by_recursion": F.when(~F.col("valid"), "O(n)").when(F.col("fibonacci_recursion") == 1, "O(2^n)").when(F.col("self_calls") > 0, "O(n)")
        .when(F.col("direct_depth") >= 2, "O(n²)").when(F.col("direct_depth") == 1, "O(n)").otherwise("O(1)"),
        "by_words": F.when((recursive > 1) & low.contains("fibonacci"), "O(2^n)").when(depth >= 2, "O(n²)").when(depth == 1, "O(n)")
        .when(low.rlike("sort|merge"), "O(n log n)").when(low.rlike("binary|search"), "O(log n)").otherwise("O(1)"),
        "by_loop_count": _power(F.col("loop_run")),
        "by_visitor": F.when(~F.col("valid"), "O(n)").when((depth == 0) & (recursive == 0), "O(1)").when(F.col("binary_search") == 1, "O(log n)")
        .when((F.col("divides") == 1) & (depth > 0), "O(n log n)").when(F.col("divides") == 1, "O(log n)")
        .when(depth >= 3, "O(n³)").when(depth == 2, "O(n²)").when(depth == 1, "O(n)").when(F.col("fibonacci_name") == 1, "O(2^n)").otherwise("O(n)"),
        "by_features": F.when((F.col("self_calls") > 0) & low.contains("fibonacci"), "O(2^n)").when(F.col("n_for") + F.col("n_while") >= 2, "O(n²)")
        .when(F.col("n_for") + F.col("n_while") > 0, "O(n)").otherwise("O(1)"),
        "by_stack": F.when(~F.col("valid") | (F.trim(code) == ""), "O(?)").when(depth == 3, "O(n^3)").otherwise(_power(depth)),
    }


def _power(n: Column) -> Column:
    """O(1), O(n), O(n²), O(n³) and O(n^d) beyond."""
    return F.when(n == 0, "O(1)").when(n == 1, "O(n)").when(n == 2, "O(n²)").when(n == 3, "O(n³)").otherwise(F.concat(F.lit("O(n^"), n.cast("string"), F.lit(")")))


def algorithm_pattern(code: Column, kind: Column) -> Column:
    """Algorithmic pattern from features, the text and its algorithm type; null where it does not parse."""
    found = (
        F.when(F.col("most_inner_loops") > 1, "iterative_nested")
        .when((F.col("first_recursive") == 1) & (F.col("halves") > 0), "recursive_divide_conquer")
        .when(F.col("first_recursive") == 1, "recursive")
        .when(F.col("n_for") + F.col("n_while") > 0, "iterative_simple")
        .otherwise("constant")
    )
    return F.when(F.col("valid"), F.when((kind == "search") & F.lower(code).contains("binary"), "logarithmic").otherwise(found))


#: The 30 features of the technique classifier, in their order.
FEATURES30 = (
    "nested_loops function_calls variables conditionals list_operations lines_of_code for_loops while_loops range_usage enumerate_usage "
    "dict_usage set_usage list_usage append_calls get_calls sum_pattern comparison_pattern max_min_pattern sorting_usage len_usage "
    "has_nested_loops has_triple_nested membership_testing conditional_complexity substring_pattern duplicate_pattern pair_pattern "
    "max_pattern count_pattern frequency_pattern"
).split()


def features30(code: Column) -> dict[str, Column]:
    """FEATURES30 as columns over ``features`` and the text; all zero where the code does not parse."""
    ten, flags = text.features10(code), text.usage_flags(code)
    depth = F.col("loop_depth")
    own = (
        depth, F.col("n_calls"), F.col("n_plain_assigns"), F.col("n_ifs"), F.col("n_list_calls5"), ten["n_lines"], ten["n_for"], ten["n_while"],
        ten["n_range"], text.occurrences(code, "enumerate"), flags["uses_dict"], flags["uses_set"], flags["uses_list"], flags["n_append"],
        flags["n_get"], flags["sum_pattern"], flags["comparison_pattern"], flags["uses_min_max"], flags["uses_sorting"], flags["uses_len"],
        (depth >= 2).cast("int"), (depth >= 3).cast("int"), flags["membership"], ten["n_if"], flags["says_substring"], flags["says_duplicate"],
        flags["says_pair"], flags["says_extreme"], flags["says_count"], flags["says_frequency"],
    )
    return {n: F.when(F.col("valid"), c).otherwise(0).cast("double") for n, c in zip(FEATURES30, own, strict=True)}


#: The 20 features of the second classifier, in their order.
FEATURES20 = (
    "loop_depth n_calls n_plain_assigns n_ifs n_list_calls4 has_nested_loops has_list_comp has_builtin uses_sorting uses_slicing uses_dict uses_set "
    "uses_list uses_tuple sum_pattern search_pattern comparison_pattern counting_pattern duplicate_pattern max_min_pattern"
).split()


def features20(code: Column) -> dict[str, Column]:
    flags = text.usage_flags(code)
    made = {
        "has_nested_loops": F.col("loop_depth") >= 2, "has_list_comp": F.col("n_list_comps") > 0, "sum_pattern": flags["sum_pattern"],
        "search_pattern": code.rlike("in.*range.*in.*range"), "comparison_pattern": flags["comparison_pattern"],
        "counting_pattern": code.rlike(r"count.*\+\+|count.*\+="), "duplicate_pattern": code.rlike("duplicate|same.*element"),
        "max_min_pattern": code.rlike(r"max\(|min\(|maximum|minimum"),
    }
    return {n: F.when(F.col("valid"), made.get(n, F.col(n)).cast("int")).otherwise(0).cast("double") for n in FEATURES20}


#: The seven features of the small classifier, in their order.
FEATURES7 = "code_length num_lines num_functions num_loops max_nesting_depth has_recursion num_if_statements".split()


def features7(code: Column) -> dict[str, Column]:
    loops = F.col("n_for") + F.col("n_while")
    own = (F.length(code), text.line_count(code), F.col("n_functions"), loops, F.least(loops, F.lit(3)), (F.col("self_calls") > 0).cast("int"), F.col("n_ifs"))
    return {n: c.cast("double") for n, c in zip(FEATURES7, own, strict=True)}


def pattern(code: Column) -> Column:
    """First structural pattern that fits a nested loop, null if none does."""
    nested = F.col("loop_depth") >= 2
    found = (F.col("equality") == 1) & (F.col("return_in_loop") == 1)
    return (
        F.when(nested & found & code.contains("+") & (F.col("names_target") == 1), "two_sum")
        .when(nested & found & code.contains("True") & code.contains("False"), "contains_duplicate")
        .when(nested & (F.col("sum_call") == 1) & (F.col("max_call") == 1), "max_subarray")
        .when(nested & ((F.col("sum_call") == 1) | code.contains("+")), "nested_sum")
        .when(nested & F.lower(code).rlike("count|freq"), "frequency")
    )
