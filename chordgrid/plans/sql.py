"""Pieces of the SQL twins: common table expressions over the driver's tables."""

from __future__ import annotations

from chordgrid.operators.neighbours import EIGHT

PIXELS = """px AS MATERIALIZED (
    SELECT vec_id AS imgid, label, vec_id * 64 + i AS oid, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v
    FROM embeddings, range(64) t(i))"""
POINTS = f"{PIXELS}, pt AS MATERIALIZED (SELECT imgid, oid, y, x, v FROM px WHERE v > 0.1)"


def cells(points: str, radius: float) -> str:
    """The points in cells as wide as the radius, as a select."""
    return f"SELECT *, CAST(floor(y / {radius!r}) AS BIGINT) AS cy, CAST(floor(x / {radius!r}) AS BIGINT) AS cx FROM {points}"


#: The steps to a cell and the eight around it.
STEPS = "(SELECT s // 3 - 1 AS sy, s % 3 - 1 AS sx FROM range(9) t(s))"


def edges(points: str = "pt", radius: float = EIGHT, name: str = "ed") -> str:
    return f"""{name}_c AS MATERIALIZED ({cells(points, radius)}),
    {name}_n AS MATERIALIZED (SELECT imgid, oid, y, x, cy + sy AS cy, cx + sx AS cx FROM {name}_c, {STEPS}),
    {name} AS MATERIALIZED (
        SELECT a.imgid, a.oid AS lf, b.oid AS rt, sqrt(CAST((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE)) AS d
        FROM {name}_n a JOIN {name}_c b ON a.imgid = b.imgid AND a.cy = b.cy AND a.cx = b.cx
        WHERE a.oid < b.oid AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {radius * radius!r})"""


DEGREES = """bi AS MATERIALIZED (SELECT lf, rt FROM ed UNION ALL SELECT rt, lf FROM ed),
    dg AS MATERIALIZED (SELECT p.imgid, p.oid, count(b.lf) AS degree FROM pt p LEFT JOIN bi b ON b.rt = p.oid GROUP BY 1, 2)"""
ENDPOINTS = """be AS MATERIALIZED (
        SELECT DISTINCT b.lf AS oid FROM bi b JOIN dg a ON a.oid = b.lf JOIN dg c ON c.oid = b.rt WHERE c.degree < a.degree),
    en AS MATERIALIZED (SELECT p.* FROM pt p LEFT JOIN be ON be.oid = p.oid WHERE be.oid IS NULL)"""
COMPONENTS = """reach(oid, other) AS (
        SELECT oid, oid FROM pt UNION SELECT r.oid, b.rt FROM reach r JOIN bi b ON b.lf = r.other),
    cc AS (SELECT p.imgid, p.oid, min(r.other) AS ccid FROM pt p JOIN reach r ON r.oid = p.oid GROUP BY 1, 2)"""


def query(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"
