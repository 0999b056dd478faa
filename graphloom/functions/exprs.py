"""Column functions of the graph queries; all of them stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from graphloom.schema import DECAY, OTHER_WEIGHT, WEIGHTS

TEST_PATH = r"(?i)(^|/)(tests?|specs?|__tests__|__mocks__)(/|$)|[.-](test|spec)\."


def normal_path(path: Column) -> Column:
    """Back slashes become slashes."""
    return F.translate(path, "\\", "/")


def view_path(path: Column) -> Column:
    """normal_path without a leading ``./``."""
    return F.regexp_replace(normal_path(path), r"^\./", "")


#: Fixed value: what the paths of nodes without a file begin with.
VIRTUAL = "__virtual__/"


def virtual_path(kind: Column, node: Column) -> Column:
    """The path that stands for a node without a file; null if kind or id is null."""
    return F.concat(F.lit(VIRTUAL), kind, F.lit("/"), F.translate(normal_path(node), ":", "_"))


def is_virtual_path(path: Column) -> Column:
    """Null is no path at all, so not a virtual one."""
    return F.coalesce(path.startswith(VIRTUAL), F.lit(False))


def collated(c: Column) -> Column:
    """For ordering: user-visible order is by locale collation, not by bytes."""
    return F.collate(c, "UNICODE")


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in WEIGHTS.items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(3,2)")


def walked(score: Column, w: Column) -> Column:
    """A walk's score one edge on, rounded to six decimals."""
    return F.round(score * F.lit(DECAY).cast("decimal(3,2)") * w, 6).cast("decimal(10,6)")


def lexical_score(query: str, name: Column, id_: Column, path: Column, signature: Column) -> Column:
    """1 for the name or id itself, 0.9 for a prefix, 0.75 and 0.6 for all or any terms in them, 0.45 for a term in path or signature, else 0."""
    q = query.strip().lower()
    terms = q.split()
    if not terms:
        return F.lit("0").cast("decimal(10,6)")
    n, i = F.lower(name), F.lower(id_)
    other = (F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(signature, F.lit(""))))
    both = [n.contains(t) | i.contains(t) for t in terms]
    every, some = both[0], both[0]
    for b in both[1:]:
        every, some = every & b, some | b
    aside = F.lit(False)
    for t in terms:
        aside = aside | other[0].contains(t) | other[1].contains(t)
    ladder = F.when((n == q) | (i == q), "1").when(n.startswith(q) | i.startswith(q), "0.9").when(every, "0.75").when(some, "0.6").when(aside, "0.45").otherwise("0")
    return ladder.cast("decimal(10,6)")


def edge_key() -> Column:
    """type|src|dst|file_path|line with nothing for null, so a line sorts as text."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", "src", "dst", "file_path", "line")))


def without_generics(text: Column, depth: int = 4) -> Column:
    """Without ``<...>``, nested up to depth."""
    for _ in range(depth):
        text = F.regexp_replace(text, "<[^<>]*>", "")
    return text


def qualified(text: Column) -> Column:
    """Without white space and ``global::``."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"\bglobal::", "")


def name_variants(text: Column) -> Column:
    """The name without generics, ``[]``, ``?`` and outer blanks, and its right-most segment."""
    n = F.regexp_replace(F.regexp_replace(without_generics(text), r"\[\]|\?", ""), r"^\s+|\s+$", "")
    last = F.get(F.reverse(F.filter(F.split(n, r"\."), lambda part: part != "")), F.lit(0))
    return F.array_distinct(F.array_compact(F.array(n, last)))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    left, right = (F.filter(F.split(normal_path(p), "/"), lambda part: part != "") for p in (a, b))
    same = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    stop = F.array_position(F.transform(same, lambda s: s.cast("int")), 0)
    return F.coalesce(F.when(stop == 0, F.size(same)).otherwise(stop - 1), F.lit(0)).cast("int")


def module_key(path: Column) -> Column:
    """First path segment, ``(root)`` for a bare file, ``(virtual)`` for none."""
    p = view_path(path)
    return F.when(path.isNull() | (p == "") | is_virtual_path(p), "(virtual)").when(~p.contains("/"), "(root)").otherwise(F.split(p, "/")[0])


def method_name(text: str) -> str:
    """The method that a symbol id, a call or a qualified name speaks of."""
    t = text.strip().rstrip("#")
    t = (t.rpartition("#")[2] or t).lstrip("@")
    t = t.split("@")[0].split("(")[0].rstrip(".")
    t = re.sub(r"<[^>]*>", "", t.rpartition(".")[2] or t).strip()
    words = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", t)
    inner = [w for w in words if re.search("[A-Z]", w[1:])]
    return inner[-1] if inner else words[-1] if words else t
