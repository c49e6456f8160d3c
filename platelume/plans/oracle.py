"""The same tables and operators as SQL text, for comparison: named common table expressions and what they need."""

from __future__ import annotations

from ..functions.neighbours import gaussian_weights
from ..sources.fixtures import SELECTIONS, SIDE, VALUE


def _range(n: int, name: str) -> str:
    return f"(SELECT CAST(range AS INT) AS {name} FROM range({n}))"


_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"
_LOOSE = "_([A-Pa-p])(\\d{1,2})-(\\d+)"

#: name -> (names it needs, body)
PARTS: dict[str, tuple[str, str]] = {
    "pixels": (
        "",
        f"""SELECT CAST(image_id AS BIGINT) AS image_id, channel, z, y, x, {VALUE} AS value FROM (
          SELECT *, (image_id*7)%9 + 9 AS cy, (image_id*5)%7 + 9 AS cx FROM (SELECT s_suppkey AS image_id FROM supplier)
          CROSS JOIN {_range(2, "channel")} CROSS JOIN {_range(3, "z")} CROSS JOIN {_range(SIDE, "y")} CROSS JOIN {_range(SIDE, "x")})""",
    ),
    "images": ("", "SELECT CAST(s_suppkey AS BIGINT) AS image_id, '/plate/img_' || s_suppkey || '.vsi' AS path, ['DAPI', 'GFP'] AS channel_names, 0.5::DOUBLE AS px FROM supplier"),
    "files": (
        "",
        f"""SELECT '/plate/__EXP_P1_' || r || cf || '_' || lpad(CAST(2*k+v+1 AS VARCHAR), 5, '0') || '.vsi' AS path FROM w, {_range(3, "v")} WHERE v=0 OR (v=1 AND k%10<>9) OR (v=2 AND k%13=0)
          UNION ALL SELECT '/plate/overview_' || k || '.vsi' FROM w WHERE k%20=0
          UNION ALL SELECT '/out/rois/_' || r || cf || '_hole.roi' FROM w WHERE k%3=0
          UNION ALL SELECT '/out/rois/_' || r || cf || '_background.tif' FROM w WHERE k%6=0
          UNION ALL SELECT '/plate/class' || (1+k%2) || '___EXP_P1_' || CASE WHEN k%8=0 THEN lower(r) ELSE r END || cf || '_00002.roi' FROM w WHERE k%4=0""",
    ),
    "w": ("", "SELECT s_suppkey AS k, chr(CAST(65 + CAST(floor(s_suppkey/24) AS INT) % 16 AS INT)) AS r, (s_suppkey%24+1) || '-' || (1+CAST(floor(s_suppkey/384) AS INT)) AS cf FROM supplier"),
    "vertices": (
        "",
        """SELECT CAST(s_suppkey AS BIGINT) AS image_id, ord, CAST((s_suppkey*7)%9 + 9 + dy AS INT) AS vrow, CAST((s_suppkey*5)%7 + 9 + dx AS INT) AS vcol
          FROM supplier, (VALUES (0,-8,0),(1,0,8),(2,8,0),(3,0,-8)) AS p(ord, dy, dx)""",
    ),
    "classes": ("pixels", "SELECT image_id, y, x, CAST(CASE WHEN value>=100 THEN 2 WHEN value>=60 THEN 3 ELSE 1 END AS INT) AS label, least(1.0, value/128.0) AS prob FROM pixels WHERE channel=0 AND z=1"),
    "noise": (
        "",
        """SELECT CAST(floor(vec_id/64) AS BIGINT) AS image_id, CAST(vec_id%64 AS INT) AS y, CAST(i-1 AS INT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE)+1)*128) AS DOUBLE) AS value
          FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
    ),
    "sel": ("", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SELECTIONS) + ") AS s(label, source, existing_tag)"),
    # plate
    "parsed": (
        "files",
        f"""SELECT path, upper(regexp_extract({_STEM}, '{_LOOSE}_(\\d+)$', 1)) AS row, CAST(regexp_extract({_STEM}, '{_LOOSE}_(\\d+)$', 2) AS INT) AS col,
          CAST(regexp_extract({_STEM}, '{_LOOSE}_(\\d+)$', 3) AS INT) AS field, CAST(regexp_extract({_STEM}, '{_LOOSE}_(\\d+)$', 4) AS INT) AS serial
          FROM files WHERE path LIKE '%.vsi' AND regexp_matches({_STEM}, '{_LOOSE}_(\\d+)$')""",
    ),
    "wells": (
        "parsed",
        """SELECT row, col, field, row || col AS well_id, max(path) FILTER (n=1) AS bf_path, max(path) FILTER (n=2) AS fl_path, max(serial) FILTER (n=1) AS bf_serial, max(serial) FILTER (n=2) AS fl_serial,
          coalesce(string_agg(path, '|' ORDER BY n) FILTER (n>2), '') AS extras
          FROM (SELECT *, row_number() OVER (PARTITION BY row, col, field ORDER BY serial, path) AS n FROM parsed) GROUP BY ALL""",
    ),
    "rois": (
        "files, wells",
        f"""SELECT wells.row, wells.col, wells.field, well_id, path AS roi_path, CASE WHEN suffix(st, '_hole') THEN 'hole' WHEN suffix(st, '_background') THEN 'background' ELSE 'existing' END AS kind,
          CAST(row_number() OVER (PARTITION BY wells.row, wells.col, wells.field ORDER BY place, ext, path) AS INT) AS ord
          FROM (SELECT path, {_STEM} AS st, CASE WHEN path LIKE '/out/rois/%' THEN 1 ELSE 0 END AS place, CASE WHEN path LIKE '%.roi' THEN 1 ELSE 3 END AS ext,
            upper(regexp_extract({_STEM}, '{_LOOSE}', 1)) AS r, TRY_CAST(regexp_extract({_STEM}, '{_LOOSE}', 2) AS INT) AS c, TRY_CAST(regexp_extract({_STEM}, '{_LOOSE}', 3) AS INT) AS f
            FROM files WHERE path LIKE '%.roi' OR path LIKE '/out/rois/%.tif') p JOIN wells ON wells.row=r AND wells.col=c AND wells.field=f""",
    ),
    "resolved": (
        "wells, rois, sel",
        f"""SELECT a.row, a.col, a.field, a.well_id, label, source, arg_min(roi_path, ord) FILTER (roi_path IS NOT NULL AND (source<>'well_existing' OR contains(lower({_STEM.replace("path", "roi_path")}), lower(existing_tag)))) AS roi_path
          FROM wells a CROSS JOIN sel LEFT JOIN rois b ON a.row=b.row AND a.col=b.col AND a.field=b.field AND b.kind = CASE source WHEN 'well_hole' THEN 'hole' WHEN 'well_background' THEN 'background' ELSE 'existing' END
          WHERE source LIKE 'well_%' GROUP BY ALL""",
    ),
    # planes, thresholds and masks
    "plane": ("pixels", "SELECT image_id, channel, y, x, max(value) AS value FROM pixels GROUP BY ALL"),
    "m": ("plane, otsu", "SELECT image_id, y, x FROM plane JOIN otsu USING (image_id, channel) WHERE channel=0 AND value>threshold"),
    "frame": ("pixels", "SELECT image_id, CAST(max(y)+1 AS INT) AS height, CAST(max(x)+1 AS INT) AS width FROM pixels GROUP BY 1"),
    "p0": ("plane", "SELECT image_id, y, x, value FROM plane WHERE channel=0"),
    "p1": ("plane", "SELECT image_id, y, x, value FROM plane WHERE channel=1"),
}


def otsu_parts(prefix: str, plane: str) -> None:
    """Adds {prefix}rng, hist, sums and otsu: plane's ranges, histograms, their sums and thresholds."""
    rng, hist, sums = f"{prefix}rng", f"{prefix}hist", f"{prefix}sums"
    PARTS[rng] = (plane, f"SELECT image_id, channel, min(value) AS lo, max(value) AS hi FROM {plane} GROUP BY ALL")
    PARTS[hist] = (
        f"{plane}, {rng}",
        f"""SELECT image_id, channel, lo, hi, bin, coalesce(n, 0) AS n, lo + (bin+0.5)*(hi-lo)/256 AS centre FROM {rng} CROSS JOIN {_range(256, "bin")}
          LEFT JOIN (SELECT image_id, channel, CAST(least(255, floor((value-lo)/(hi-lo)*256)) AS INT) AS bin, count(*) AS n FROM {plane} JOIN {rng} USING (image_id, channel) GROUP BY ALL) USING (image_id, channel, bin)""",
    )
    PARTS[sums] = (
        hist,
        f"""SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w1, CAST(sum(n) OVER a AS DOUBLE) AS w2, sum(n*centre) OVER u AS s1, sum(n*centre) OVER a AS s2 FROM {hist}
          WINDOW u AS (PARTITION BY image_id, channel ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id, channel ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    )
    PARTS[f"{prefix}otsu"] = (sums, f"SELECT image_id, channel, centre AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY w1*w2*(s1/w1-s2/w2)*(s1/w1-s2/w2) DESC, bin) AS k FROM {sums} WHERE bin<255) WHERE k=1")


def blur(sigma: float) -> str:
    """(image_id, y, x, value) of p0 blurred."""
    w = gaussian_weights(sigma)
    r, n = len(w) // 2, SIDE
    mirror = lambda c: f"CASE WHEN ({c}+k) < 0 THEN -1-({c}+k) WHEN ({c}+k) >= {n} THEN {2 * n - 1}-({c}+k) ELSE {c}+k END"
    ws = "(VALUES " + ", ".join(f"({k - r}, CAST({x!r} AS DOUBLE))" for k, x in enumerate(w)) + ") AS g(k, wt)"
    return f"""SELECT a.image_id, a.y, a.x, sum(wt*b.value) AS value FROM p0 a CROSS JOIN {ws} JOIN
      (SELECT a.image_id, a.y, a.x, sum(wt*b.value) AS value FROM p0 a CROSS JOIN {ws} JOIN p0 b ON b.image_id=a.image_id AND b.x=a.x AND b.y={mirror("a.y")} GROUP BY ALL) b
      ON b.image_id=a.image_id AND b.y=a.y AND b.x={mirror("a.x")} GROUP BY ALL"""


otsu_parts("", "plane")
PARTS["blurred"] = ("p0", f"SELECT image_id, 0 AS channel, y, x, value FROM ({blur(2.0)})")
otsu_parts("b", "blurred")
PARTS["bm"] = ("blurred, botsu", "SELECT image_id, y, x FROM blurred JOIN botsu USING (image_id, channel) WHERE value>threshold")
_EARLIER = {8: "(-1,-1),(-1,0),(-1,1),(0,-1)", 4: "(-1,0),(0,-1)"}
_STEPS = {8: "(-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)", 4: "(-1,0),(0,-1),(0,1),(1,0)"}


def flood(name: str, mask: str, needs: str, connectivity: int, extra: str = "") -> None:
    """Adds {name}: mask's rows with s, the raster place of their component's first pixel. extra: a column that separates masks."""
    e = f", {extra}" if extra else ""
    on = "m.image_id=f.image_id" + (f" AND m.{extra}=f.{extra}" if extra else "")
    m_e = f", m.{extra}" if extra else ""
    PARTS[f"{name}_r"] = (
        needs,
        # only a pixel without an earlier neighbour can be its component's first
        f"""SELECT image_id{e}, y, x, y*100000+x AS s FROM {mask} f WHERE NOT EXISTS (SELECT 1 FROM {mask} m, (VALUES {_EARLIER[connectivity]}) AS o(dy, dx) WHERE {on} AND m.y=f.y+o.dy AND m.x=f.x+o.dx) UNION
          SELECT m.image_id{m_e}, m.y, m.x, f.s FROM {name}_r f CROSS JOIN (VALUES {_STEPS[connectivity]}) AS o(dy, dx) JOIN {mask} m ON {on} AND m.y=f.y+o.dy AND m.x=f.x+o.dx WHERE f.s < m.y*100000+m.x""",
    )
    PARTS[name] = (f"{name}_r", f"SELECT image_id{e}, y, x, min(s) AS s FROM {name}_r GROUP BY ALL")


#: Mosaics hold this many images one below the other, this far apart and this far down, so that objects lie over the borders of tiles.
MOSAIC, STRIDE, DOWN = 20, 64, 48
PARTS["mosaic"] = ("m", f"SELECT CAST(image_id//{MOSAIC} AS BIGINT) AS image_id, CAST(image_id%{MOSAIC}*{STRIDE}+y+{DOWN} AS INT) AS y, x FROM m")

flood("ccm", "mosaic", "mosaic", 8)
flood("cc8", "m", "m", 8)
flood("cc4", "m", "m", 4)
PARTS["lab"] = ("cc8", "SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY s) AS INT) AS label FROM cc8")
for _mask, _rest, _filled in (("m", "bg", "filled"), ("bm", "bbg", "bfilled")):
    PARTS[_rest] = (f"frame, {_mask}", f"SELECT image_id, y, x FROM frame CROSS JOIN {_range(SIDE, 'y')} CROSS JOIN {_range(SIDE, 'x')} ANTI JOIN {_mask} USING (image_id, y, x)")
    flood(f"cc_{_rest}", _rest, _rest, 4)
    PARTS[_filled] = (
        f"cc_{_rest}, {_mask}",
        f"""SELECT image_id, y, x FROM {_mask} UNION ALL SELECT image_id, y, x FROM cc_{_rest} WHERE (image_id, s) NOT IN (SELECT (image_id, s) FROM cc_{_rest} WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}))""",
    )
PARTS["fg"] = ("classes", "SELECT image_id, y, x FROM classes WHERE prob>=0.5")
flood("ccf", "fg", "fg", 8)
flood("ccc", "classes", "classes", 8, "label")


def perimeters(name: str, table: str, needs: str, key: str) -> None:
    """Adds {name}: (key, area_px, perimeter_px, circularity) of table's labels."""
    cols = key.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{c}={b}.{c}" for c in cols)
    PARTS[f"{name}_b"] = (needs, f"SELECT {key}, y, x FROM {table} a WHERE (SELECT count(*) FROM {table} b, (VALUES {_STEPS[4]}) AS o(dy, dx) WHERE {on('a', 'b')} AND b.y=a.y+o.dy AND b.x=a.x+o.dx) < 4")
    PARTS[f"{name}_c"] = (
        f"{name}_b",
        f"""SELECT {", ".join("a." + c for c in cols)}, a.y, a.x, 1 + coalesce(sum(CASE WHEN b.y IS NULL THEN 0 WHEN o.dy*o.dx=0 THEN 2 ELSE 10 END), 0) AS code
          FROM {name}_b a CROSS JOIN (VALUES {_STEPS[8]}) AS o(dy, dx) LEFT JOIN {name}_b b ON {on("a", "b")} AND b.y=a.y+o.dy AND b.x=a.x+o.dx GROUP BY ALL""",
    )
    PARTS[name] = (
        f"{name}_c, {needs}",
        f"""SELECT {key}, area_px, perimeter_px, CASE WHEN perimeter_px=0 THEN 0 ELSE 4*pi()*area_px/(perimeter_px*perimeter_px) END AS circularity
          FROM (SELECT {key}, count(*) AS area_px FROM {table} GROUP BY ALL) JOIN
          (SELECT {key}, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2) WHEN code IN (13,23) THEN (1+sqrt(2))/2 ELSE 0 END) AS perimeter_px FROM {name}_c GROUP BY ALL) USING ({key})""",
    )


perimeters("shape", "lab", "lab", "image_id, label")
perimeters("shapef", "ccf", "ccf", "image_id, s")
perimeters("shapec", "ccc", "ccc", "image_id, label, s")
PARTS["stats"] = (
    "lab, p0",
    """SELECT image_id, label, count(*) AS area_px, avg(value) AS mean_intensity, max(value) AS max_intensity, min(value) AS min_intensity, avg(y) AS centroid_row, avg(x) AS centroid_col,
      min(y) AS "top", min(x) AS "left", CAST(max(y)+1 AS INT) AS bottom, CAST(max(x)+1 AS INT) AS "right" FROM lab JOIN p0 USING (image_id, y, x) GROUP BY ALL""",
)
PARTS["roi"] = ("vertices, frame", f"""SELECT image_id, y, x FROM frame CROSS JOIN {_range(SIDE, "y")} CROSS JOIN {_range(SIDE, "x")} JOIN (
  SELECT image_id, max(vrow) FILTER (ord=1) AS cy, max(vcol) FILTER (ord=0) AS cx FROM vertices GROUP BY 1) USING (image_id) WHERE abs(y-cy)+abs(x-cx) <= 8""")


# a line's stretch (l to r) of each label's convex hull: the farthest that a chord from a point above to one below comes to lie
PARTS["rim"] = (
    "lab",
    """SELECT image_id, label, y+dy AS py, min(x+dx) AS a, max(x+dx) AS b FROM lab CROSS JOIN (VALUES (0.5::DOUBLE, 0.0::DOUBLE), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5)) AS o(dy, dx) GROUP BY ALL""",
)
PARTS["hull"] = (
    "rim, lab",
    """SELECT k.image_id, k.label, k.y, min(CASE WHEN q.py=p.py THEN p.a ELSE p.a+(k.y-p.py)*(q.a-p.a)/(q.py-p.py) END) AS l, max(CASE WHEN q.py=p.py THEN p.b ELSE p.b+(k.y-p.py)*(q.b-p.b)/(q.py-p.py) END) AS r
      FROM (SELECT DISTINCT image_id, label, y FROM lab) k JOIN rim p ON p.image_id=k.image_id AND p.label=k.label AND p.py<=k.y JOIN rim q ON q.image_id=k.image_id AND q.label=k.label AND q.py>=k.y GROUP BY ALL""",
)

PARTS["dist"] = (
    "m, frame",
    f"""SELECT a.image_id, a.y, a.x, CAST(min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS BIGINT) AS d2 FROM m a
      JOIN (SELECT image_id, y, x FROM frame CROSS JOIN {_range(SIDE, "y")} CROSS JOIN {_range(SIDE, "x")} ANTI JOIN m USING (image_id, y, x)) b USING (image_id) GROUP BY ALL""",
)
#: Peaks are at least this far apart: from the highest down, those that are near none of the peaks already taken.
SPACING = 3
PARTS["cand"] = (
    "dist",
    f"""SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2 DESC, y, x) AS k FROM dist a WHERE y>={SPACING} AND x>={SPACING} AND y<{SIDE - SPACING} AND x<{SIDE - SPACING}
      AND NOT EXISTS (SELECT 1 FROM dist b WHERE b.image_id=a.image_id AND b.d2>a.d2 AND abs(b.y-a.y)<={SPACING} AND abs(b.x-a.x)<={SPACING})""",
)
PARTS["greedy"] = (
    "cand",
    f"""SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(y INT, x INT)[]) AS taken FROM cand UNION ALL
      SELECT g.image_id, c.k, CASE WHEN len([t for t in taken if abs(t.y-c.y)<{SPACING} AND abs(t.x-c.x)<{SPACING}])=0 THEN list_append(taken, {{'y': c.y, 'x': c.x}}) ELSE taken END
      FROM greedy g JOIN cand c ON c.image_id=g.image_id AND c.k=g.k+1""",
)
PARTS["peaks"] = ("greedy, dist", "SELECT image_id, y, x, d2 FROM (SELECT image_id, t.y AS y, t.x AS x FROM (SELECT image_id, unnest(arg_max(taken, k)) AS t FROM greedy GROUP BY 1)) JOIN dist USING (image_id, y, x)")
# an edge at a time, best first: part[i] is the part of an image's i-th pixel, less than 0 where it has a peak
PARTS["nodes"] = (
    "dist, peaks",
    """SELECT d.*, row_number() OVER (PARTITION BY d.image_id ORDER BY d.y, d.x) AS i, p.n FROM dist d
      LEFT JOIN (SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS n FROM peaks) p USING (image_id, y, x)""",
)
PARTS["edges"] = (
    "nodes",
    """SELECT a.image_id, a.i AS i, b.i AS j, row_number() OVER (PARTITION BY a.image_id ORDER BY least(a.d2, b.d2) DESC, greatest(a.d2, b.d2) DESC, a.y, a.x, b.y) AS k
      FROM nodes a JOIN nodes b ON a.image_id=b.image_id AND ((b.y=a.y AND b.x=a.x+1) OR (b.y=a.y+1 AND b.x=a.x))""",
)
PARTS["edgelist"] = ("edges", "SELECT image_id, list({'i': i, 'j': j} ORDER BY k) AS es FROM edges GROUP BY 1")


def _merges(n: int) -> str:
    """A step of the forest: n edges, one after the other."""
    rows = "SELECT f.image_id, k, part, es FROM forest f JOIN edgelist USING (image_id) WHERE k < len(es)"
    for s in range(1, n + 1):
        rows = f"""SELECT image_id, k, es, CASE WHEN p IS NULL OR p=q OR (p<0 AND q<0) THEN part
          ELSE [CASE WHEN c=(CASE WHEN p<0 THEN q ELSE p END) THEN (CASE WHEN p<0 THEN p ELSE q END) ELSE c END for c in part] END AS part
          FROM (SELECT *, part[es[k+{s}].i] AS p, part[es[k+{s}].j] AS q FROM ({rows}))"""
    return f"SELECT image_id, k+{n} AS k, part FROM ({rows})"


PARTS["forest"] = ("edgelist, nodes", f"SELECT image_id, CAST(0 AS BIGINT) AS k, list(coalesce(-n, i) ORDER BY i) AS part FROM nodes GROUP BY 1 UNION ALL {_merges(16)}")

# Li's fixed point: a round a row, from the mean, over each plane's distinct values less its lowest
PARTS["vals"] = ("plane, rng", "SELECT image_id, channel, value-lo AS v, CAST(count(*) AS DOUBLE) AS n FROM plane JOIN rng USING (image_id, channel) GROUP BY ALL")
PARTS["tols"] = ("vals", "SELECT image_id, channel, coalesce(min(gap)/2, 0) AS tol, sum(v*n)/sum(n) AS mean FROM (SELECT *, v-lag(v) OVER (PARTITION BY image_id, channel ORDER BY v) AS gap FROM vals) GROUP BY ALL")
PARTS["li"] = (
    "vals, tols",
    """SELECT image_id, channel, mean AS t, false AS done, 0 AS k FROM tols UNION ALL
      SELECT image_id, channel, new AS t, abs(new-t) <= tol AS done, k+1 AS k FROM (
        SELECT *, CASE WHEN back<=0 OR back IS NULL OR fore IS NULL THEN t ELSE coalesce((back-fore)/nullif(ln(back)-ln(fore), 0), t) END AS new FROM (
          SELECT image_id, channel, any_value(t) AS t, any_value(k) AS k, any_value(tol) AS tol, sum(v*n) FILTER (v>t)/sum(n) FILTER (v>t) AS fore, sum(v*n) FILTER (v<=t)/sum(n) FILTER (v<=t) AS back
          FROM li JOIN vals USING (image_id, channel) JOIN tols USING (image_id, channel) WHERE NOT done AND k<200 GROUP BY ALL))""",
)


def sql(needs: str, body: str) -> str:
    """body with the parts that it needs, each once and before what uses it."""
    order: list[str] = []

    def add(names: str) -> None:
        for n in names.split(", "):
            if n and n not in order:
                if n == "files":
                    add("w")
                add(PARTS[n][0])
                order.append(n)

    add(needs)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body
