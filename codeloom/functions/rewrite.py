"""Source rewrites of Python snippets over their syntax tree.

Rules: folding of constant arithmetic, comparisons and boolean operators; branches and loops
with a constant test; statements after return, raise, break or continue; assignments to local
names that nothing reads and whose value has no effect; append loops as comprehensions;
``range(len(x))`` loops as direct loops where the index only reads ``x``, over ``enumerate`` where it
is used otherwise too; doubly recursive Fibonacci as a loop; bubble sort as ``sort``; linear search as
``index``; the ends of a sorted list as ``min`` and ``max``; strings gathered in a loop as ``join``;
``list(map(lambda ...))`` and ``list(filter(lambda ...))`` as comprehensions; ``len(x)`` that is taken again and
again of a parameter, once; ``a < b and a != b`` as ``a < b``; ``if c: return True`` before ``return False``
as ``return c``; a name that only carries a value to the next return. Snippets are never run.

A ``range(len(x))`` loop is left alone where the rewrite could change what it does: ``x`` is no plain
name; the loop assigns or deletes ``x``, an item of it or the index, calls a method of ``x`` or lets
``x`` out of sight (any use but ``x[...]`` and ``len(x)``); or no ``x[i]`` is read. A direct loop also
needs that nothing in the scope but other loops over the index names it. ``x`` is taken for a
sequence that no other name changes during the loop.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import DataFrame

from codeloom.functions.syntax import parse, per_snippet

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor,
    ast.LShift: operator.lshift, ast.RShift: operator.rshift,
}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_, ast.Invert: operator.invert}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
#: Folding keeps away from results that grow out of hand.
MOST_POWER, MOST_BASE, MOST_SHIFT, MOST_TEXT = 100, 1000, 64, 4096
_LEAVES = (ast.Return, ast.Raise, ast.Break, ast.Continue)


def _constant(value: object) -> ast.Constant | None:
    ok = isinstance(value, (int, float, bool, str)) and not (isinstance(value, str) and len(value) > MOST_TEXT)
    return ast.Constant(value) if ok else None


def _pure(node: ast.AST) -> bool:
    return not any(isinstance(x, (ast.Call, ast.Await, ast.Yield, ast.YieldFrom, ast.NamedExpr, ast.Subscript, ast.Attribute)) for x in ast.walk(node))


_SCOPES = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_PAUSES = (ast.Await, ast.Yield, ast.YieldFrom, ast.AsyncFor, ast.AsyncWith)
#: A snippet that binds one of these, or looks at its names by them, keeps its loops.
_LOOP_NAMES = {"range", "len", "enumerate", "*"}
_BY_NAME = {"locals", "globals", "vars", "dir", "eval", "exec"}


def _bound(tree: ast.AST) -> set[str]:
    """Names that anything in the tree binds, deletes or declares."""
    out: set[str] = set()
    for x in ast.walk(tree):
        if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
            out.add(x.id)
        elif isinstance(x, ast.arg):
            out.add(x.arg)
        elif isinstance(x, ast.alias):
            out.add((x.asname or x.name).split(".")[0])
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            out.update(x.names)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.ExceptHandler, ast.MatchAs, ast.MatchStar)):
            out.add(x.name or "")
        elif isinstance(x, ast.MatchMapping):
            out.add(x.rest or "")
    return out


def _named(tree: ast.AST, name: str) -> list[ast.AST]:
    return [x for x in ast.walk(tree) if isinstance(x, ast.Name) and x.id == name]


def _length_of(node: ast.AST, call: str = "len") -> ast.expr | None:
    """The only argument of ``call(...)``."""
    ok = isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == call and len(node.args) == 1 and not node.keywords
    return node.args[0] if ok else None


class _Items(ast.NodeTransformer):
    """``x[i]`` as another name."""

    def __init__(self, x: str, i: str, item: str) -> None:
        self.x, self.i, self.item = x, i, item

    def visit_Subscript(self, node: ast.Subscript) -> ast.AST:
        if isinstance(node.value, ast.Name) and node.value.id == self.x and isinstance(node.slice, ast.Name) and node.slice.id == self.i:
            return ast.copy_location(ast.Name(self.item, ast.Load()), node)
        return self.generic_visit(node)


class Rewriter(ast.NodeTransformer):
    def __init__(self) -> None:
        self.applied: list[str] = []
        self._scopes: list[ast.AST] = []

    def _put(self, rule: str, node: ast.AST, new: ast.AST) -> ast.AST:
        self.applied.append(rule)
        return ast.copy_location(new, node)

    def visit(self, node: ast.AST) -> ast.AST:
        if not isinstance(node, _SCOPES):
            return super().visit(node)
        self._scopes.append(node)
        try:
            return super().visit(node)
        finally:
            self._scopes.pop()

    def visit_Subscript(self, node: ast.Subscript) -> ast.AST:
        """``sorted(x)[0]`` and ``sorted(x)[-1]``."""
        self.generic_visit(node)
        x = _length_of(node.value, "sorted")
        end = {"0": "min", "-1": "max"}.get(ast.unparse(node.slice))
        if x is None or end is None or not isinstance(node.ctx, ast.Load) or {"sorted", end} & _bound(self._scopes[0]):
            return node
        return self._put("sorted_end", node, ast.Call(ast.Name(end, ast.Load()), [x], []))

    def visit_Call(self, node: ast.Call) -> ast.AST:
        """``list(map(lambda v: e, x))`` and ``list(filter(lambda v: e, x))``."""
        self.generic_visit(node)
        inner = _length_of(node, "list")
        if not (isinstance(inner, ast.Call) and isinstance(inner.func, ast.Name) and inner.func.id in ("map", "filter") and len(inner.args) == 2 and not inner.keywords):
            return node
        f, x = inner.args
        a = f.args if isinstance(f, ast.Lambda) else None
        if a is None or len(a.args) != 1 or a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults or {"list", "map", "filter"} & _bound(self._scopes[0]):
            return node
        v = a.args[0].arg
        part = ast.comprehension(ast.Name(v, ast.Store()), x, [f.body] if inner.func.id == "filter" else [], 0)
        return self._put("comprehension", node, ast.ListComp(ast.Name(v, ast.Load()) if part.ifs else f.body, [part]))

    def visit_For(self, node: ast.For) -> ast.AST:
        self.generic_visit(node)
        ends = _length_of(node.iter, "range")
        over = _length_of(ends) if ends is not None else None
        if not (isinstance(over, ast.Name) and isinstance(node.target, ast.Name)) or isinstance(self._scopes[-1], ast.ClassDef):
            return node
        x, i, whole, scope, body = over.id, node.target.id, self._scopes[0], self._scopes[-1], list(ast.walk(ast.Module(node.body, [])))
        # Reads of x that leave it as it is, cheapest tests first.
        seen = {id(n.value) for n in body if isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Load)} | {id(_length_of(n)) for n in body}
        reads = [n for n in body if isinstance(n, ast.Name) and n.id == x]
        if x == i or not reads or any(id(n) not in seen for n in reads) or any(isinstance(n, _SCOPES[1:] + _PAUSES) for n in body):
            return node
        if not any(isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == x and isinstance(n.slice, ast.Name) and n.slice.id == i for n in body):
            return node
        everywhere = _bound(whole)
        names = {n.id for n in ast.walk(whole) if isinstance(n, ast.Name)} | everywhere
        declared = {n for s in ast.walk(whole) if isinstance(s, (ast.Global, ast.Nonlocal)) for n in s.names}
        if {x, i} & (_bound(ast.Module(node.body, [])) | declared) or _LOOP_NAMES & everywhere or _BY_NAME & names:
            return node
        item = f"value_{i}"
        while item in names:
            item += "_"
        items = _Items(x, i, item)
        node.body, value = [items.visit(s) for s in node.body], ast.Name(item, ast.Store())
        others = [n for n in ast.walk(scope) if isinstance(n, ast.For) and isinstance(n.target, ast.Name) and n.target.id == i]
        inside = {id(m) for f in others if f is node or node not in ast.walk(f) for part in (f.target, *(f.body if f is not node else ())) for m in ast.walk(part)}
        if any(id(n) not in inside for n in _named(scope, i)):
            node.target, node.iter = ast.Tuple([node.target, value], ast.Store()), ast.Call(ast.Name("enumerate", ast.Load()), [over], [])
        else:
            node.target, node.iter = value, over
        self.applied.append("direct_loop")
        return node

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        a, b = node.left, node.right
        if isinstance(a, ast.Constant) and isinstance(b, ast.Constant) and type(node.op) in _BINARY:
            x, y = a.value, b.value
            if isinstance(node.op, ast.Pow) and not (isinstance(y, int) and abs(y) <= MOST_POWER and isinstance(x, (int, float)) and abs(x) <= MOST_BASE):
                return node
            if isinstance(node.op, (ast.LShift, ast.RShift)) and not (isinstance(y, int) and 0 <= y <= MOST_SHIFT):
                return node
            if isinstance(node.op, ast.Mult) and (isinstance(x, (str, bytes)) or isinstance(y, (str, bytes))):
                return node
            try:
                value = _constant(_BINARY[type(node.op)](x, y))
            except (TypeError, ValueError, ArithmeticError):
                return node
            if value is not None:
                return self._put("constant_folding", node, value)
        return node

    def visit_UnaryOp(self, node: ast.UnaryOp) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float)):
            if isinstance(node.op, ast.USub):
                return node  # a negative number is written this way
            try:
                return self._put("constant_folding", node, ast.Constant(_UNARY[type(node.op)](node.operand.value)))
            except TypeError:
                return node
        return node

    def visit_Compare(self, node: ast.Compare) -> ast.AST:
        self.generic_visit(node)
        if len(node.ops) == 1 and isinstance(node.left, ast.Constant) and isinstance(node.comparators[0], ast.Constant) and type(node.ops[0]) in _COMPARE:
            try:
                value = _COMPARE[type(node.ops[0])](node.left.value, node.comparators[0].value)
            except TypeError:
                return node
            return self._put("constant_folding", node, ast.Constant(bool(value)))
        return node

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.AST:
        self.generic_visit(node)
        stop = isinstance(node.op, ast.Or)
        if not stop and (kept := _without_implied(node.values)) is not None:
            self.applied.append("implied_comparison")
            if len(kept) == 1:
                return ast.copy_location(kept[0], node)
            node.values = kept
        kept: list[ast.expr] = []
        for i, value in enumerate(node.values):
            known = isinstance(value, ast.Constant)
            if known and bool(value.value) is stop:
                kept.append(value)
                break
            if not known or i == len(node.values) - 1:
                kept.append(value)
        if len(kept) == len(node.values):
            return node
        return self._put("boolean_simplification", node, kept[0] if len(kept) == 1 else ast.BoolOp(node.op, kept))

    def _block(self, body: list[ast.stmt]) -> list[ast.stmt]:
        out: list[ast.stmt] = []
        for at, statement in enumerate(body):
            if isinstance(statement, ast.If) and isinstance(statement.test, ast.Constant):
                self.applied.append("dead_branch")
                out += statement.body if statement.test.value else statement.orelse
            elif isinstance(statement, ast.While) and isinstance(statement.test, ast.Constant) and not statement.test.value:
                self.applied.append("dead_branch")
                out += statement.orelse
            else:
                out.append(statement)
            if out and isinstance(out[-1], _LEAVES):
                if at + 1 < len(body):
                    self.applied.append("unreachable_code")
                break
        return out or [ast.Pass()]

    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        for field in ("body", "orelse", "finalbody"):
            block = getattr(node, field, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
                block = self._block(block)
                if field == "body":
                    block = self._returns(self._comprehensions(block))
                setattr(node, field, block)
        return node

    def _comprehensions(self, body: list[ast.stmt]) -> list[ast.stmt]:
        """``x = []`` directly before a loop that only appends to it becomes a comprehension."""
        out: list[ast.stmt] = []
        for statement in body:
            new = _as_comprehension(out[-1], statement) if out else None
            if new is not None:
                self.applied.append("list_comprehension")
                out[-1] = ast.copy_location(new, out[-1])
            else:
                out.append(statement)
        return out

    def _returns(self, body: list[ast.stmt]) -> list[ast.stmt]:
        """``if c: return True`` then ``return False``, and a name set only to be returned."""
        out: list[ast.stmt] = []
        for statement in body:
            before, new = (out[-1] if out else None), None
            if isinstance(statement, ast.Return) and isinstance(before, ast.If) and isinstance(before.test, ast.Compare) and not before.orelse:
                says = [x.value.value if isinstance(x, ast.Return) and isinstance(x.value, ast.Constant) else None for x in (*before.body, statement)]
                if len(before.body) == 1 and says == [True, False] and all(type(x) is bool for x in says):
                    rule, new = "boolean_return", ast.Return(before.test)
            elif (
                isinstance(statement, ast.Return) and isinstance(statement.value, ast.Name) and isinstance(before, ast.Assign)
                and len(before.targets) == 1 and isinstance(before.targets[0], ast.Name) and before.targets[0].id == statement.value.id
                and isinstance(self._scopes[-1], ast.FunctionDef) and len(_named(self._scopes[-1], statement.value.id)) == 2
            ):
                rule, new = "direct_return", ast.Return(before.value)
            if new is not None:
                self.applied.append(rule)
                out[-1] = ast.copy_location(new, before)
            else:
                out.append(statement)
        return out

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        for rule, change in _WHOLE_FUNCTIONS:
            if change(node):
                self.applied.append(rule)
        self.generic_visit(node)
        read = {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
        shared = {n for x in ast.walk(node) if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}

        def unused(s: ast.stmt) -> bool:
            return (
                isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)
                and s.targets[0].id not in read | shared and _pure(s.value)
            )

        kept = [s for s in node.body if not unused(s)]
        if len(kept) < len(node.body):
            self.applied.append("unused_variable")
            node.body = kept or [ast.Pass()]
        return node


def _without_implied(values: list[ast.expr]) -> list[ast.expr] | None:
    """The values of an ``and`` without ``a != b`` beside ``a < b`` or ``a > b``; None if there is none."""
    sides = {
        (ast.dump(v.left), ast.dump(v.comparators[0]))
        for v in values
        if isinstance(v, ast.Compare) and len(v.ops) == 1 and isinstance(v.ops[0], (ast.Lt, ast.Gt)) and _pure(v)
    }

    def implied(v: ast.expr) -> bool:
        if not (isinstance(v, ast.Compare) and len(v.ops) == 1 and isinstance(v.ops[0], ast.NotEq)):
            return False
        a, b = ast.dump(v.left), ast.dump(v.comparators[0])
        return (a, b) in sides or (b, a) in sides

    kept = [v for v in values if not implied(v)]
    return kept if len(kept) < len(values) else None


def _same(node: ast.AST | None, *texts: str) -> bool:
    return node is not None and ast.unparse(node) in texts


def _statements(text: str) -> list[ast.stmt]:
    """The statements of a text, which may return."""
    return ast.parse("def _():\n" + "\n".join(f"    {line}" for line in text.split("\n"))).body[0].body


def _fibonacci(f: ast.FunctionDef) -> bool:
    """A base case that gives n below 2 and then f(n - 1) + f(n - 2), in this order or the other."""
    a = f.args
    if len(a.args) != 1 or a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or f.decorator_list:
        return False
    n, skip = a.args[0].arg, 1 if ast.get_docstring(f) is not None else 0
    body = f.body[skip:]
    if len(body) == 1 and isinstance(body[0], ast.If) and len(body[0].orelse) == 1:
        body = [ast.If(body[0].test, body[0].body, []), body[0].orelse[0]]
    if len(body) != 2 or not isinstance(body[0], ast.If) or body[0].orelse or not isinstance(body[1], ast.Return):
        return False
    base = _same(body[0].test, f"{n} <= 1", f"{n} < 2") and len(body[0].body) == 1 and _same(body[0].body[0], f"return {n}")
    one, two = f"{f.name}({n} - 1)", f"{f.name}({n} - 2)"
    if not base or not _same(body[1].value, f"{one} + {two}", f"{two} + {one}") or n in ("a", "b"):
        return False
    f.body = f.body[:skip] + [body[0]] + _statements(f"a, b = 0, 1\nfor _ in range({n} - 1):\n    a, b = b, a + b\nreturn b")
    return True


def _bubble_sort(f: ast.FunctionDef) -> bool:
    """Full passes of adjacent swaps over a parameter; the counters must not be used elsewhere."""
    lengths = {s.targets[0].id: s.value.args[0].id for s in f.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(_length_of(s.value), ast.Name)}
    for at, outer in enumerate(f.body):
        inner = outer.body[0] if isinstance(outer, ast.For) and len(outer.body) == 1 and not outer.orelse else None
        swap = inner.body[0] if isinstance(inner, ast.For) and len(inner.body) == 1 and not inner.orelse else None
        if not (isinstance(swap, ast.If) and isinstance(outer.target, ast.Name) and isinstance(inner.target, ast.Name) and len(swap.body) == 1 and not swap.orelse):
            continue
        i, j = outer.target.id, inner.target.id
        for x in {a.arg for a in f.args.args}:
            this, following = f"{x}[{j}]", f"{x}[{j} + 1]"
            if not _same(swap.test, f"{this} > {following}", f"{following} < {this}"):
                continue
            if not _same(swap.body[0], f"{this}, {following} = ({following}, {this})", f"{following}, {this} = ({this}, {following})"):
                continue
            for n in (f"len({x})", *(k for k, v in lengths.items() if v == x)):
                passes = f"range({n})", f"range({n} - 1)"
                steps = [f"{start}{n} - {less}" for start in ("", "0, ") for less in (f"{i} - 1", f"1 - {i}", "1")]
                if _same(outer.iter, *passes) and _same(inner.iter, *(f"range({s})" for s in steps)):
                    used = {id(y) for y in ast.walk(outer)}
                    if not any(isinstance(y, ast.Name) and y.id in (i, j) and id(y) not in used for y in ast.walk(f)):
                        f.body[at] = _statements(f"{x}.sort()")[0]
                        return True
    return False


def _linear_search(f: ast.FunctionDef) -> bool:
    """A loop that returns the first index whose item equals a value, and -1 behind it."""
    for at in range(len(f.body) - 1):
        loop, last = f.body[at : at + 2]
        test = loop.body[0] if isinstance(loop, ast.For) and len(loop.body) == 1 and not loop.orelse else None
        if not (isinstance(test, ast.If) and not test.orelse and len(test.body) == 1 and isinstance(loop.target, ast.Name) and _same(last, "return -1")):
            continue
        i, ends = loop.target.id, _length_of(loop.iter, "range")
        x = _length_of(ends) if ends is not None else None
        if isinstance(x, ast.Name) and isinstance(test.test, ast.Compare) and _same(test.body[0], f"return {i}"):
            item, sides = f"{x.id}[{i}]", [test.test.left, *test.test.comparators]
            other = [s for s in sides if not _same(s, item)]
            if len(sides) == 2 and len(other) == 1 and isinstance(test.test.ops[0], ast.Eq) and isinstance(other[0], (ast.Name, ast.Constant)) and not _same(other[0], i):
                v = ast.unparse(other[0])
                f.body[at : at + 2] = _statements(f"return {x.id}.index({v}) if {v} in {x.id} else -1")
                return True
    return False


def _joined_text(f: ast.FunctionDef) -> bool:
    """``s = ''`` directly before a loop that only adds to it."""
    for at in range(len(f.body) - 1):
        first, loop = f.body[at : at + 2]
        if not (isinstance(first, ast.Assign) and len(first.targets) == 1 and isinstance(first.targets[0], ast.Name) and _same(first.value, "''")):
            continue
        add = loop.body[0] if isinstance(loop, ast.For) and len(loop.body) == 1 and not loop.orelse else None
        s = first.targets[0].id
        if isinstance(add, ast.AugAssign) and isinstance(add.op, ast.Add) and _same(add.target, s) and not any(_named(part, s) for part in (add.value, loop.iter)):
            made = ast.GeneratorExp(add.value, [ast.comprehension(loop.target, loop.iter, [], 0)])
            first.value = ast.Call(ast.Attribute(ast.Constant(""), "join", ast.Load()), [made], [])
            del f.body[at + 1]
            return True
    return False


def _length_once(f: ast.FunctionDef) -> bool:
    """``len(x)`` of a parameter that nothing rebinds, changes or hands on, taken at least three times."""
    skip = 1 if ast.get_docstring(f) is not None else 0
    if "len" in _bound(f) or any(isinstance(n, _SCOPES[1:] + _PAUSES) for n in ast.walk(f) if n is not f):
        return False
    for x in (a.arg for a in f.args.args):
        calls = [n for n in ast.walk(f) if isinstance(_length_of(n), ast.Name) and _length_of(n).id == x]
        quiet = {id(_length_of(n)) for n in calls} | {id(n.value) for n in ast.walk(f) if isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Load)}
        # The first statement that runs takes the length anyway, so nothing fails earlier than it would.
        sure = len(f.body) > skip and any(c in list(ast.walk(f.body[skip].iter if isinstance(f.body[skip], ast.For) else f.body[skip].value)) for c in calls) if len(f.body) > skip and isinstance(f.body[skip], (ast.For, ast.Assign)) else False
        name = f"len_{x}"
        if len(calls) < 3 or not sure or name in _bound(f) or any(id(n) not in quiet for n in _named(f, x)):
            continue
        for call in calls:
            call.func, call.args = ast.Name("_once", ast.Load()), []

        class Put(ast.NodeTransformer):
            def visit_Call(self, node: ast.Call) -> ast.AST:
                self.generic_visit(node)
                return ast.Name(name, ast.Load()) if isinstance(node.func, ast.Name) and node.func.id == "_once" else node  # noqa: B023

        f.body = f.body[:skip] + _statements(f"{name} = len({x})") + [Put().visit(s) for s in f.body[skip:]]
        return True
    return False


_WHOLE_FUNCTIONS = (
    ("iterative_fibonacci", _fibonacci), ("bubble_sort", _bubble_sort), ("linear_search", _linear_search), ("joined_text", _joined_text),
    ("length_once", _length_once),
)


def _as_comprehension(first: ast.stmt, loop: ast.stmt) -> ast.stmt | None:
    if not (isinstance(first, ast.Assign) and len(first.targets) == 1 and isinstance(first.targets[0], ast.Name)):
        return None
    if not (isinstance(first.value, ast.List) and not first.value.elts and isinstance(loop, ast.For) and not loop.orelse and len(loop.body) == 1):
        return None
    name, inner, tests = first.targets[0].id, loop.body[0], []
    if isinstance(inner, ast.If) and not inner.orelse and len(inner.body) == 1:
        tests, inner = [inner.test], inner.body[0]
    call = inner.value if isinstance(inner, ast.Expr) else None
    if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "append" and len(call.args) == 1):
        return None
    if not (isinstance(call.func.value, ast.Name) and call.func.value.id == name):
        return None
    used = (loop.iter, call.args[0], *tests)
    if any(isinstance(x, ast.Name) and x.id == name for part in used for x in ast.walk(part)):
        return None
    made = ast.ListComp(call.args[0], [ast.comprehension(loop.target, loop.iter, tests, 0)])
    return ast.Assign(first.targets, made)


def rewrite(code: str | None) -> tuple[str | None, list[str]]:
    """(rewritten code, rules in the order of their use); code that does not parse stays."""
    tree = parse(code)
    if tree is None:
        return code, []
    rewriter = Rewriter()
    try:
        done = ast.unparse(ast.fix_missing_locations(rewriter.visit(tree)))
    except (RecursionError, ValueError):
        return code, []
    return (done, rewriter.applied) if rewriter.applied else (code, [])


def _row(code: str | None) -> list[dict]:
    done, rules = rewrite(code)
    return [{"rewritten": done, "rules": rules}]


def rewrites(df: DataFrame, key: str, code: str) -> DataFrame:
    return per_snippet(df, key, code, "rewritten string, rules array<string>", _row)
