"""Code generated for a technique from templates, with a snippet's own function name and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import function_name, function_parameters

#: Template of each technique; <name>, <args>, <first> and <second> stand for parts of the snippet's header.
TEMPLATES = {
    "hash_map": """def <name>(<args>):
    seen = {}
    for i, value in enumerate(<first>):
        if <second> - value in seen:
            return [seen[<second> - value], i]
        seen[value] = i
    return []""",
    "hash_set": """def <name>(<args>):
    seen = set()
    for value in <first>:
        if value in seen:
            return True
        seen.add(value)
    return False""",
    "dynamic_programming": """def <name>(<args>):
    best = run = 0
    for at, value in enumerate(<first>):
        run = max(value, run + value) if at else value
        best = max(best, run) if at else run
    return best""",
    "two_pointers": """def <name>(<args>):
    ordered, low = sorted(<first>), 0
    high, pairs = len(ordered) - 1, []
    while low < high:
        total = ordered[low] + ordered[high]
        if total == <second>:
            pairs.append((ordered[low], ordered[high]))
        low, high = (low + 1, high) if total <= <second> else (low, high - 1)
    return pairs""",
    "sliding_window": """def <name>(<args>):
    last, low, best = {}, 0, 0
    for at, value in enumerate(<first>):
        low = max(low, last.get(value, -1) + 1)
        last[value] = at
        best = max(best, at - low + 1)
    return best""",
    "frequency_map": """def <name>(<args>):
    counts = {}
    for value in <first>:
        counts[value] = counts.get(value, 0) + 1
    return counts""",
}


def parameter(code: Column, place: int, default: str) -> Column:
    """Name of a parameter of the first function, without annotation and default value."""
    part = F.get(F.split(function_parameters(code), ","), F.lit(place))
    return F.coalesce(F.nullif(F.regexp_extract(part, "[A-Za-z_][A-Za-z0-9_]*", 0), F.lit("")), F.lit(default))


def generated(code: Column, technique: Column) -> Column:
    """The technique's template filled from the snippet's header; the snippet itself for any other technique."""
    args = F.coalesce(F.nullif(F.trim(function_parameters(code)), F.lit("")), F.lit("items, target"))
    values = {"<name>": function_name(code), "<args>": args, "<first>": parameter(code, 0, "items"), "<second>": parameter(code, 1, "target")}
    chain = None
    for name, template in TEMPLATES.items():
        filled = F.lit(template)
        for slot, value in values.items():
            filled = F.replace(filled, F.lit(slot), value)
        chain = F.when(technique == name, filled) if chain is None else chain.when(technique == name, filled)
    return chain.otherwise(code)
