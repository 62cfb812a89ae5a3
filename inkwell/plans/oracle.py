"""DuckDB SQL for the registered queries, put together from named steps."""

from __future__ import annotations

from inkwell.operators import raster, score

STEPS: dict[str, str] = {
    "fx_gray": """SELECT CAST(label AS INT) AS page_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c,
  CAST(floor(greatest(0::DOUBLE, least(255::DOUBLE, (e::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE))) AS INT) AS gray
  FROM (SELECT label, r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS e
        FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings) v) t""",
    "fx_low": "SELECT page_id, r, c, CAST(80 + gray // 4 AS INT) AS gray FROM fx_gray",
    "fx_bin": "SELECT page_id, r, c, CAST(gray < 105 AS INT) AS ink FROM fx_gray",
    "fx_box": """SELECT CAST(o_orderkey // 300 AS INT) AS page_id, CAST(o_orderkey % 300 AS INT) AS det_seq, CAST(o_custkey % 200 AS INT) AS x1,
  CAST((o_orderkey * 37) % 300 AS INT) AS y1, CAST(o_custkey % 200 + 20 + o_custkey % 120 AS INT) AS x2, CAST((o_orderkey * 37) % 300 + 15 + o_orderkey % 60 AS INT) AS y2 FROM orders""",
    "fx_b": """SELECT *, CASE WHEN line % 5 = 1 THEN 1 ELSE 0 END AS eq FROM (SELECT o_orderkey AS k, o_custkey AS ck, o_orderkey // 300 AS page_id,
  (o_orderkey // 300) % 3 AS pk, (o_orderkey % 300) // 20 AS line, o_orderkey % 20 AS slot FROM orders)""",
    "fx_s": """SELECT k, page_id, pk, ck,
  CASE WHEN k % 97 = 0 OR k % 151 = 0 THEN 260 WHEN eq = 0 THEN 18 + ck % 3
       ELSE CASE ck % 6 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 20 WHEN 3 THEN 38 WHEN 4 THEN 50 ELSE 3 END END AS h,
  CASE WHEN k % 97 = 0 THEN 3 WHEN k % 151 = 0 THEN 16 WHEN eq = 1 THEN CASE WHEN ck % 6 = 5 THEN 90 ELSE 10 + ck % 9 END
       ELSE CASE pk WHEN 0 THEN 14 WHEN 1 THEN 20 ELSE 28 END + ck % 6 END AS w,
  CASE WHEN k % 97 <> 0 AND k % 151 = 0 THEN 2 ELSE CASE WHEN eq = 1 AND pk <> 2 THEN 250 ELSE 40 END + slot * 34 + ck % 5 END AS x1,
  CASE WHEN pk = 2 THEN 12 + line * 23 ELSE 60 + line * 60 END + CASE WHEN eq = 1 THEN ck % 17 ELSE ck % 3 END AS y1
  FROM fx_b WHERE (eq = 0 AND (pk <> 0 OR slot < 8)) OR (eq = 1 AND (pk = 2 OR slot BETWEEN 3 AND 9))""",
    "fx_blob": """SELECT CAST(page_id AS INT) AS page_id, CAST(k AS BIGINT) AS blob_seq, 800 AS img_w, CAST(CASE WHEN pk = 2 THEN 354 ELSE 1000 END AS INT) AS img_h,
  CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x1 + w - 1 AS INT) AS x2, CAST(y1 + h - 1 AS INT) AS y2, CAST(w AS INT) AS width, CAST(h AS INT) AS height,
  CAST((w * h * (CASE WHEN pk = 0 THEN 15 ELSE 40 END + ck % 50)) // 100 AS INT) AS area FROM fx_s""",
    "font": """SELECT page_id, height AS font_size FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY plain DESC, n DESC, first) AS turn FROM (
    SELECT page_id, 1 AS plain, height, count(*) AS n, min(blob_seq) AS first FROM fx_blob WHERE area > 10 AND height > 4 GROUP BY ALL
    UNION ALL SELECT page_id, 0, height, count(*), min(blob_seq) FROM fx_blob GROUP BY ALL)) WHERE turn = 1""",
    "den1": """SELECT b.page_id, any_value(img_w) AS img_w, any_value(img_h) AS img_h, any_value(font_size) AS font_size, count(*) AS total_blobs,
  sum(area)::DOUBLE / (any_value(img_w) * any_value(img_h)) AS ink_density,
  count(*) FILTER (height >= font_size * 0.60::DOUBLE AND height <= font_size * 1.40::DOUBLE) / count(*) AS body_ratio,
  greatest(1::DOUBLE, any_value(img_h) / (any_value(font_size) * 1.5::DOUBLE)) AS estimated_lines FROM fx_blob b JOIN font f ON b.page_id = f.page_id GROUP BY b.page_id""",
    "den2": """SELECT *, total_blobs / estimated_lines AS blobs_per_line,
  CASE WHEN ink_density < 0.025 THEN -1 WHEN ink_density >= 0.055 THEN 1 ELSE 0 END AS vote_ink,
  CASE WHEN body_ratio < 0.45 THEN -1 WHEN body_ratio >= 0.65 THEN 1 ELSE 0 END AS vote_body,
  CASE WHEN total_blobs / estimated_lines < 12 THEN -1 WHEN total_blobs / estimated_lines >= 25 THEN 1 ELSE 0 END AS vote_bpl FROM den1""",
    "density": """SELECT *, vote_ink + vote_body + vote_bpl AS vote_sum, CASE WHEN vote_ink + vote_body + vote_bpl = 3 THEN 2 WHEN vote_ink + vote_body + vote_bpl < 0 THEN 0 ELSE 1 END AS density_class,
  CASE WHEN abs(vote_ink + vote_body + vote_bpl) = 3 THEN 0.90 WHEN vote_ink + vote_body + vote_bpl >= 1 THEN 0.65 WHEN vote_ink + vote_body + vote_bpl < 0 THEN 0.70 ELSE 0.60 END::DOUBLE AS density_confidence FROM den2""",
    "lines": """SELECT b.*, font_size, CASE
  WHEN w >= h AND h <= font_size * 0.6::DOUBLE AND w >= img_w * 0.10::DOUBLE AND w / greatest(h, 1) >= 6 THEN 'horizontal_line'
  WHEN h >= w AND w <= font_size * 0.6::DOUBLE AND h >= img_h * 0.10::DOUBLE AND h / greatest(w, 1) >= 6 THEN 'vertical_line'
  WHEN ((y1 <= 12 OR y2 >= img_h - 12) AND w >= img_w * 0.15::DOUBLE) OR ((x1 <= 12 OR x2 >= img_w - 12) AND h >= img_h * 0.15::DOUBLE) THEN 'frame_stroke' END AS reject_reason
  FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM fx_blob) b JOIN font f ON b.page_id = f.page_id""",
    "clean": """SELECT l.page_id, blob_seq, l.img_w, l.img_h, x1, y1, x2, y2, width, height, area, l.font_size, density_class, width / height AS aspect_ratio,
  (y1 + y2) / 2.0::DOUBLE AS center_r, (x1 + x2) / 2.0::DOUBLE AS center_c, row_number() OVER (PARTITION BY l.page_id ORDER BY y1, x1, blob_seq) AS rk,
  l.font_size * [0.8, 0.7, 0.5][density_class + 1]::DOUBLE AS vg, l.font_size * [2.4, 2.2, 1.8][density_class + 1]::DOUBLE AS hg FROM lines l JOIN density d ON l.page_id = d.page_id WHERE reject_reason IS NULL""",
    "edges": """SELECT a.page_id, a.rk AS a, b.rk AS b FROM clean a JOIN clean b ON a.page_id = b.page_id AND a.rk < b.rk
  AND b.y1 - a.y2 <= a.vg AND greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= a.hg""",
    "ties": "SELECT page_id, a, b FROM edges UNION ALL SELECT page_id, b, a FROM edges",
    "reach": "SELECT page_id, rk AS node, rk AS reach FROM clean UNION SELECT r.page_id, b.b, r.reach FROM reach r JOIN ties b ON r.page_id = b.page_id AND r.node = b.a",
    "member": "SELECT c.*, line FROM clean c JOIN (SELECT page_id, node, min(reach) AS line FROM reach GROUP BY ALL) t ON c.page_id = t.page_id AND c.rk = t.node",
    "line": """SELECT page_id, line, any_value(font_size) AS font_size, any_value(density_class) AS density_class, any_value(hg) AS hg, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
  count(*) AS blob_count, sum(area) AS area, max(x2) - min(x1) + 1 AS width, max(y2) - min(y1) + 1 AS height, sum(area)::DOUBLE / ((max(x2) - min(x1) + 1) * (max(y2) - min(y1) + 1)) AS density FROM member GROUP BY page_id, line""",
    "gap": "SELECT *, row_number() OVER w AS turn, lag(gap) OVER w AS before FROM (SELECT page_id, line, font_size, lead(y1) OVER (PARTITION BY page_id ORDER BY y1, line) - y2 AS gap FROM line) WHERE gap > 0 WINDOW w AS (PARTITION BY page_id ORDER BY gap, line)",
    "pgap": """SELECT p.page_id, least(p.font_size * 4.0::DOUBLE, CASE WHEN p.n < 3 OR coalesce(g.n, 0) < 3 THEN p.font_size * 2.5::DOUBLE
    ELSE greatest(p.font_size * 1.1::DOUBLE, coalesce(jump + 2, least_gap - 1, p.font_size * 1.1::DOUBLE)) END) AS para_gap
  FROM (SELECT page_id, any_value(font_size) AS font_size, count(*) AS n FROM line GROUP BY page_id) p LEFT JOIN (
    SELECT page_id, count(*) AS n, arg_min(before, turn) FILTER (gap >= font_size AND gap > before * 1.5::DOUBLE) AS jump, min(gap) FILTER (gap >= font_size) AS least_gap FROM gap GROUP BY page_id) g ON p.page_id = g.page_id""",
    "super": "SELECT l.*, para_gap AS vg, row_number() OVER (PARTITION BY l.page_id ORDER BY y1, x1, line) AS rk FROM line l JOIN pgap g ON l.page_id = g.page_id",
    "edges2": """SELECT a.page_id, a.rk AS a, b.rk AS b FROM super a JOIN super b ON a.page_id = b.page_id AND a.rk < b.rk
  AND b.y1 - a.y2 <= a.vg AND greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= a.hg""",
    "ties2": "SELECT page_id, a, b FROM edges2 UNION ALL SELECT page_id, b, a FROM edges2",
    "reach2": "SELECT page_id, rk AS node, rk AS reach FROM super UNION SELECT r.page_id, b.b, r.reach FROM reach2 r JOIN ties2 b ON r.page_id = b.page_id AND r.node = b.a",
    "placed": """SELECT m.*, para, row_number() OVER (PARTITION BY m.page_id, para ORDER BY s.rk, m.rk) AS pos FROM member m JOIN super s ON m.page_id = s.page_id AND m.line = s.line
  JOIN (SELECT page_id, node, min(reach) AS para FROM reach2 GROUP BY ALL) t ON s.page_id = t.page_id AND s.rk = t.node""",
    "para": """SELECT page_id, para, any_value(font_size) AS font_size, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS blob_count, sum(area) AS area,
  max(x2) - min(x1) + 1 AS width, max(y2) - min(y1) + 1 AS height, sum(area)::DOUBLE / ((max(x2) - min(x1) + 1) * (max(y2) - min(y1) + 1)) AS density FROM placed GROUP BY page_id, para HAVING density >= 0.02""",
    "keyed": """SELECT m.*, split, CASE split WHEN 'column' THEN center_c WHEN 'strip' THEN center_r ELSE 0 END AS key FROM placed m JOIN (
    SELECT page_id, para, CASE WHEN width / height > 25 THEN 'column' WHEN height > font_size * 20.0::DOUBLE THEN 'strip' ELSE 'none' END AS split FROM para) p ON m.page_id = p.page_id AND m.para = p.para""",
    "cut": "SELECT *, CASE split WHEN 'column' THEN CAST(x1 - lag(x2) OVER w > hg AS INT) WHEN 'strip' THEN CAST(y1 - lag(y2) OVER w > vg * 1.5::DOUBLE AS INT) ELSE 0 END AS cut FROM keyed WINDOW w AS (PARTITION BY page_id, para ORDER BY key, pos)",
    "parts": "SELECT *, CAST(sum(coalesce(cut, 0)) OVER (PARTITION BY page_id, para ORDER BY key, pos ROWS UNBOUNDED PRECEDING) AS INT) AS part FROM cut",
    "region_": """SELECT page_id, para, part, split, any_value(font_size) AS font_size, any_value(density_class) AS density_class, any_value(img_w) AS img_w, any_value(img_h) AS img_h, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
  count(*) AS blob_count, sum(area) AS area, max(x2) - min(x1) + 1 AS width, max(y2) - min(y1) + 1 AS height, sum(area)::DOUBLE / ((max(x2) - min(x1) + 1) * (max(y2) - min(y1) + 1)) AS density FROM parts GROUP BY page_id, para, part, split
  HAVING density >= CASE WHEN split = 'strip' THEN 0.02::DOUBLE / sqrt(greatest(1::DOUBLE, (max(y2) - min(y1) + 1) / any_value(font_size))) ELSE 0.02::DOUBLE END""",
    "cfg": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(k), *(f"{v[k]}::DOUBLE" for v in score.CONFIG.values())]) + ")" for k in range(3)) + ") t(cfg_class, " + ", ".join(score.CONFIG) + ")",
    "joined": """SELECT m.*, cfg.*, r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2, m.font_size::DOUBLE AS fs,
  (m.height > m.font_size * 1.8::DOUBLE) AS tall, (m.width > m.font_size * 4 AND m.height < m.font_size * 0.5::DOUBLE) AS flat,
  (center_c < r.x1 + (r.x2 - r.x1) * 0.15::DOUBLE OR center_c > r.x1 + (r.x2 - r.x1) * 0.85::DOUBLE) AS outer_
  FROM parts m JOIN region_ r ON m.page_id = r.page_id AND m.para = r.para AND m.part = r.part JOIN cfg ON cfg_class = m.density_class
  WHERE r.x2 > r.x1 AND r.y2 > r.y1 AND NOT r.y2 < m.img_h * 0.05::DOUBLE""",
    "feat0": """SELECT page_id, para, part, any_value(density_class) AS density_class, any_value(fs) AS fs, any_value(img_w) AS img_w, any_value(rx1) AS rx1, any_value(ry1) AS ry1, any_value(rx2) AS rx2, any_value(ry2) AS ry2,
  count(*) AS n, sqrt((count(*) * sum(height * height) - sum(height) * sum(height))::DOUBLE) / sum(height) AS cv_h, stddev_pop(aspect_ratio) / avg(aspect_ratio) AS cv_ar,
  (count(*) FILTER (tall) + count(*) FILTER (flat)) / count(*) AS outlier_ratio,
  count(*) FILTER (width > fs * frac_bar_w_factor AND height <= greatest(2::DOUBLE, fs * frac_bar_h_factor)) AS frac_bars,
  count(*) FILTER (height > fs * 1.5::DOUBLE) / count(*) AS tall_sym_ratio, avg(height) / any_value(fs) AS mean_h_ratio, (max(center_r) - min(center_r)) / any_value(fs) AS center_span,
  count(*) FILTER (height >= fs * 0.6::DOUBLE AND height <= fs * 1.4::DOUBLE) / count(*) AS body_ratio,
  count(*) FILTER (abs(center_r - (ry1 + ry2) / 2.0::DOUBLE) <= fs * 0.35::DOUBLE) / count(*) AS band_ratio,
  sum(area)::DOUBLE / greatest(1, (any_value(rx2) - any_value(rx1)) * (any_value(ry2) - any_value(ry1))) AS area_ratio,
  count(*) FILTER (aspect_ratio > 0.3::DOUBLE AND aspect_ratio < 3 AND height < fs * 1.3::DOUBLE) / count(*) AS operator_ratio,
  count(*) FILTER (tall OR flat) AS odd, count(*) FILTER ((tall OR flat) AND NOT outer_) AS inner_odd FROM joined GROUP BY page_id, para, part HAVING count(*) >= 2""",
    "feat": """SELECT f.*, cfg.*, rx2 - rx1 AS w, ry2 - ry1 AS h, (ry2 - ry1) / fs AS height_ratio, (rx2 - rx1) / (ry2 - ry1) AS region_ar, n / greatest(1::DOUBLE, (ry2 - ry1) / fs) AS blobs_per_lh,
  n / greatest(1::DOUBLE, (rx2 - rx1) / fs) AS text_density, abs((rx1 + rx2) / 2.0::DOUBLE - img_w / 2.0::DOUBLE) / img_w < 0.20::DOUBLE AND rx2 - rx1 < img_w * 0.75::DOUBLE AS centered FROM feat0 f JOIN cfg ON cfg_class = density_class""",
    "rated0": """SELECT *, CASE WHEN blobs_per_lh < 4 THEN 3 WHEN blobs_per_lh < 12 THEN 1 ELSE 0 END
  + 2 * (cv_h > cv_h_low)::INT + 2 * (cv_h > cv_h_high)::INT + (cv_ar > 0.8)::INT + 2 * (outlier_ratio > outlier_low)::INT + 3 * (outlier_ratio > outlier_high)::INT
  + (height_ratio > height_ratio_min)::INT + (region_ar < region_ar_bonus)::INT + (center_span > 1.2)::INT + (body_ratio < 0.4)::INT
  + CASE WHEN frac_bars >= 1 THEN frac_bar_score ELSE 0 END + CASE WHEN tall_sym_ratio > tall_sym_threshold THEN tall_sym_score ELSE 0 END
  + (centered AND cv_h > 0.45)::INT + 2 * (operator_ratio > 0.18)::INT + 3 * (cv_h > 0.7 AND cv_ar > 0.6 AND body_ratio < 0.4)::INT
  - 3 * (cv_h < 0.2 AND height_ratio < 1.3)::INT - 4 * (region_ar > 8 AND h < fs * 1.3::DOUBLE)::INT - 2 * (center_span < 0.7)::INT - 2 * (body_ratio > 0.7 AND height_ratio < 1.6)::INT
  - (band_ratio > 0.7 AND height_ratio < 1.6)::INT - 2 * (area_ratio > 0.35 AND height_ratio > 2.5)::INT - 4 * (n > 10 AND odd > 0 AND inner_odd = 0 AND region_ar > 8)::INT AS base_score,
  (text_density > 2.5 AND cv_h < 0.45) OR (mean_h_ratio > 1.6 AND height_ratio < 5 AND n < 40 AND cv_h < 0.5 AND tall_sym_ratio < 0.05 AND frac_bars = 0)
  OR (region_ar > 4 AND height_ratio < 1.5 AND center_span < 0.9 AND body_ratio > single_line_body_ratio)
  OR (n <= small_blob_max AND height_ratio < small_h_ratio_max AND center_span < 1 AND body_ratio > 0.5 AND band_ratio > 0.5)
  OR (region_ar > wide_uniform_ar AND cv_h < 0.5 AND cv_ar < 0.5 AND band_ratio > 0.6)
  OR (height_ratio > para_h_ratio AND cv_h < para_cv_h AND outlier_ratio < 0.10 AND body_ratio > 0.45)
  OR (height_ratio > 6 AND cv_h < 0.55 AND outlier_ratio < 0.12 AND body_ratio > 0.50) OR (region_ar > 15 AND height_ratio < 4 AND cv_h < 0.55)
  OR (fs <= font_size_small AND cv_h < 0.65 AND frac_bars = 0 AND tall_sym_ratio < 0.05) AS guarded FROM feat""",
    "rated": """SELECT *, CAST(CASE WHEN NOT guarded THEN base_score WHEN region_ar > 6 AND height_ratio < 1.5 AND center_span < 0.9 AND body_ratio > single_line_body_ratio THEN -99
  WHEN frac_bars >= 1 AND height_ratio > 2 AND region_ar < 5 THEN frac_bar_score + 2 WHEN tall_sym_ratio > tall_sym_threshold AND height_ratio > 2.5 THEN 5 ELSE -99 END AS INT) AS score FROM rated0""",
    "cand": """SELECT page_id, para, part, rx1 AS x1, ry1 AS y1, rx2 AS x2, ry2 AS y2, round(least(1, greatest(0, score / 20::DOUBLE)), 3) AS confidence, 0 AS class FROM rated
  WHERE score >= score_threshold AND least(1, greatest(0, score / 20::DOUBLE)) > confidence_cutoff""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (x2 - x1) * (y2 - y1) DESC, para, part) AS rk FROM cand",
    "nms": """SELECT page_id, 0::BIGINT AS turn, []::BIGINT[] AS kept FROM (SELECT DISTINCT page_id FROM ranked) UNION ALL
  SELECT n.page_id, n.turn + 1, CASE WHEN EXISTS (SELECT 1 FROM ranked k WHERE k.page_id = n.page_id AND list_contains(n.kept, k.rk) AND least(d.x2, k.x2) > greatest(d.x1, k.x1) AND least(d.y2, k.y2) > greatest(d.y1, k.y1)
    AND (least(d.x2, k.x2) - greatest(d.x1, k.x1)) * (least(d.y2, k.y2) - greatest(d.y1, k.y1)) / ((d.x2 - d.x1) * (d.y2 - d.y1)) >= 0.7::DOUBLE) THEN n.kept ELSE list_append(n.kept, d.rk) END
  FROM nms n JOIN ranked d ON d.page_id = n.page_id AND d.rk = n.turn + 1""",
    "det": """SELECT r.page_id, row_number() OVER (PARTITION BY r.page_id ORDER BY r.rk) AS rank, r.x1, r.y1, r.x2, r.y2, r.confidence, r.class, d.img_w, d.img_h FROM ranked r
  JOIN (SELECT page_id, arg_max(kept, turn) AS kept FROM nms GROUP BY page_id) n ON r.page_id = n.page_id AND list_contains(n.kept, r.rk) JOIN density d ON d.page_id = r.page_id""",
    "texts": "SELECT page_id, x1, y1, x2, y2 FROM region_ r WHERE NOT EXISTS (SELECT 1 FROM det d WHERE (d.page_id, d.x1, d.y1, d.x2, d.y2) = (r.page_id, r.x1, r.y1, r.x2, r.y2))",
    "crop": """SELECT page_id, rank, row_number() OVER (PARTITION BY page_id ORDER BY y1, rank) AS index, x1, y1, x2, y2, greatest(0, x1 - 10) AS cx1, greatest(0, y1 - 10) AS cy1,
  least(img_w, x2 + 10) AS cx2, least(img_h, y2 + 10) AS cy2, confidence FROM det""",
}
RECURSIVE = {"reach", "reach2", "nms"}


def steps(upto: str, final: str, names: list[str] | None = None) -> str:
    """WITH all steps to `upto` (or the named ones), then the final query."""
    order = list(STEPS)
    use = names or [s for s in order[: order.index(upto) + 1] if s not in ("fx_gray", "fx_low", "fx_bin", "fx_box")]
    return "WITH RECURSIVE " + ", ".join(f"{s} AS {'' if s in RECURSIVE else 'MATERIALIZED '}({STEPS[s]})" for s in use) + " " + final


def _hist(source: str, keys: str) -> str:
    return f"""SELECT *, sum(n) OVER w AS bn, sum(n * gray) OVER w AS bs, sum(n) OVER (PARTITION BY {keys}) AS t, sum(n * gray) OVER (PARTITION BY {keys}) AS ts
  FROM (SELECT {keys}, gray, count(*) AS n FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY gray ROWS UNBOUNDED PRECEDING)"""


def _otsu(source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(CASE WHEN max(v) > 0 THEN arg_max(gray, (v, -gray)) ELSE 0 END AS INT) AS threshold, sum(n) FILTER (gray < 128) / max(t) AS dark FROM (
  SELECT *, CASE WHEN t > bn THEN (bn * (t - bn))::DOUBLE * ((bs::DOUBLE / bn - (ts - bs)::DOUBLE / (t - bn)) * (bs::DOUBLE / bn - (ts - bs)::DOUBLE / (t - bn))) ELSE 0 END AS v FROM ({_hist(source, keys)})) GROUP BY {keys}"""


def limits(source: str) -> str:
    return f"SELECT *, hi - lo < 120 AS low_contrast FROM (SELECT page_id, min(gray) FILTER (bn > floor(0.02::DOUBLE * t)) AS lo, min(gray) FILTER (bn > floor(0.98::DOUBLE * t)) AS hi FROM ({_hist(source, 'page_id')}) GROUP BY page_id)"


def blur(radius: int) -> str:
    def line(v: str, w: str) -> str:
        parts = []
        for k, weight in zip(range(-radius, radius + 1), raster.kernel(radius), strict=True):
            at = v if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}({v}, {abs(k)}) OVER {w}, {'first' if k < 0 else 'last'}_value({v}) OVER {w}w)"
            parts.append(f"{at} * {weight!r}::DOUBLE")
        return " + ".join(parts)

    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"""WITH fx_gray AS ({STEPS['fx_gray']}), half AS (SELECT page_id, r, c, {line('gray', 'a')} AS half FROM fx_gray WINDOW a AS (PARTITION BY page_id, r ORDER BY c), aw AS (PARTITION BY page_id, r ORDER BY c {frame}))
  SELECT page_id, r, c, CAST(round_even({line('half', 'd')}, 0) AS INT) AS gray FROM half WINDOW d AS (PARTITION BY page_id, c ORDER BY r), dw AS (PARTITION BY page_id, c ORDER BY r {frame})"""


TILES = f"""WITH fx_gray AS MATERIALIZED ({STEPS['fx_gray']}), size AS (SELECT page_id, greatest(32, least(128, trunc((max(r) + 1) / 74.0::DOUBLE * 3)::INT)) AS tile FROM fx_gray GROUP BY page_id),
  tiled AS (SELECT g.*, tile, r // tile AS tr, c // tile AS tc FROM fx_gray g JOIN size s ON g.page_id = s.page_id), page AS ({_otsu('fx_gray', 'page_id')}),
  tiles AS (SELECT o.page_id, tr, tc, CASE WHEN coalesce(o.dark, 0) < 0.03 THEN least(o.threshold, p.threshold) ELSE o.threshold END AS threshold FROM ({_otsu('tiled', 'page_id, tr, tc')}) o JOIN page p ON o.page_id = p.page_id)"""
ADAPTIVE = TILES + """, edge AS (SELECT page_id, max(tr) AS ltr, max(tc) AS ltc FROM tiles GROUP BY page_id),
  spot AS (SELECT t.page_id, r, c, gray, ltr, ltc, (r + 0.5::DOUBLE) / tile - 0.5::DOUBLE AS tf, (c + 0.5::DOUBLE) / tile - 0.5::DOUBLE AS cf FROM tiled t JOIN edge e ON t.page_id = e.page_id),
  low AS (SELECT *, greatest(0, least(ltr - 1, floor(tf)::INT)) AS r0, greatest(0, least(ltc - 1, floor(cf)::INT)) AS c0 FROM spot),
  four AS (SELECT l.*, tf - r0 AS dr, cf - c0 AS dc, a.threshold AS a, b.threshold AS b, d.threshold AS d, e.threshold AS e FROM low l
    JOIN tiles a ON a.page_id = l.page_id AND a.tr = r0 AND a.tc = c0 JOIN tiles b ON b.page_id = l.page_id AND b.tr = r0 AND b.tc = least(c0 + 1, ltc)
    JOIN tiles d ON d.page_id = l.page_id AND d.tr = least(r0 + 1, ltr) AND d.tc = c0 JOIN tiles e ON e.page_id = l.page_id AND e.tr = least(r0 + 1, ltr) AND e.tc = least(c0 + 1, ltc))
  SELECT page_id, r, c, CAST(gray < a * (1 - dr) * (1 - dc) + b * (1 - dr) * dc + d * dr * (1 - dc) + e * dr * dc + 5 AS INT) AS ink FROM four"""


def morph(kinds: str) -> str:
    """e and d, one after the other, on fx_bin."""
    sql, source = f"WITH fx_gray AS ({STEPS['fx_gray']}), fx_bin AS MATERIALIZED ({STEPS['fx_bin']})", "fx_bin"
    for i, kind in enumerate(kinds):
        test = "count(*) FILTER (n.ink = 1) = 9" if kind == "e" else "count(*) FILTER (n.ink = 1) >= 1"
        sql += f""", m{i} AS MATERIALIZED (SELECT p.page_id, p.r, p.c, CAST({test} AND p.r > 0 AND p.c > 0 AND p.r < any_value(s.b) AND p.c < any_value(s.e) AS INT) AS ink FROM {source} p
  JOIN (SELECT page_id, max(r) AS b, max(c) AS e FROM fx_bin GROUP BY page_id) s ON s.page_id = p.page_id JOIN (SELECT page_id, r + i AS r, c + j AS c, ink FROM {source}, range(-1, 2) u(i), range(-1, 2) v(j)) n
  ON n.page_id = p.page_id AND n.r = p.r AND n.c = p.c GROUP BY p.page_id, p.r, p.c)"""
        source = f"m{i}"
    return f"{sql} SELECT * FROM {source}"


GRAY = f"WITH fx_gray AS ({STEPS['fx_gray']}), fx_low AS ({STEPS['fx_low']}) "
RUNS = f"WITH RECURSIVE fx_gray AS ({STEPS['fx_gray']}), fx_bin AS MATERIALIZED ({STEPS['fx_bin']}), runs AS MATERIALIZED (SELECT page_id, r, min(c) AS c0, max(c) AS c1 FROM (SELECT page_id, r, c, c - row_number() OVER (PARTITION BY page_id, r ORDER BY c) AS i FROM fx_bin WHERE ink = 1) GROUP BY page_id, r, i)"
BLOBS = RUNS + """, size AS (SELECT page_id, max(r) + 1 AS img_h, max(c) + 1 AS img_w FROM fx_bin GROUP BY page_id), node AS MATERIALIZED (SELECT u.*, u.r * img_w + c0 AS k, img_w, img_h FROM runs u JOIN size s ON u.page_id = s.page_id),
  touch AS MATERIALIZED (SELECT a.page_id, a.k AS a, b.k AS b FROM node a JOIN node b ON a.page_id = b.page_id AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
  reach AS (SELECT page_id, k AS node, k AS reach FROM node UNION SELECT q.page_id, t.b, q.reach FROM reach q JOIN touch t ON q.page_id = t.page_id AND q.node = t.a),
  found AS (SELECT n.page_id, p.label AS blob_seq, any_value(img_w) AS img_w, any_value(img_h) AS img_h, min(c0) AS x1, min(r) AS y1, max(c1) AS x2, max(r) AS y2, max(c1) - min(c0) + 1 AS width, max(r) - min(r) + 1 AS height, sum(c1 - c0 + 1)::INT AS area
    FROM node n JOIN (SELECT page_id, node, min(reach) AS label FROM reach GROUP BY ALL) p ON n.page_id = p.page_id AND n.k = p.node GROUP BY n.page_id, p.label)
  SELECT *, area / (width * height) AS fill_ratio, width / height AS aspect_ratio, (y1 + y2) / 2.0::DOUBLE AS center_r, (x1 + x2) / 2.0::DOUBLE AS center_c FROM found WHERE area >= 5 AND width * height <= img_w * img_h * 0.03::DOUBLE"""

_RAW = STEPS["fx_gray"]
_SPREAD = f"SELECT g.page_id, r, c, CASE WHEN low_contrast AND hi > lo THEN greatest(0, least(255, CAST(trunc((gray - lo) * (255.0::DOUBLE / (hi - lo))) AS INT))) ELSE gray END AS gray FROM ({_RAW}) g JOIN ({limits(f'({_RAW})')}) l ON g.page_id = l.page_id"
_HEAD, _SHAPES = BLOBS.replace("reach", "tied").rsplit("\n  SELECT *, area", 1)


def from_pixels(upto: str, final: str) -> str:
    """From gray pixels, spread where contrast is low, over ink and blobs to a step."""
    order = [s for s in STEPS if not s.startswith("fx_")]
    more = ", ".join(f"{s} AS {'' if s in RECURSIVE else 'MATERIALIZED '}({STEPS[s]})" for s in order[: order.index(upto) + 1])
    return _HEAD.replace(STEPS["fx_bin"], ADAPTIVE.replace(_RAW, _SPREAD)) + f", fx_blob AS MATERIALIZED (SELECT *, area{_SHAPES}), {more} {final}"


def flagged(radius: int, tile: int, kinds: str) -> str:
    """Ink of the pages of low contrast: spread, blurred, with tiles of one size, then eroded and dilated."""
    spread = _SPREAD.replace(_RAW, f"SELECT page_id, r, c, CAST(80 + gray // 4 AS INT) AS gray FROM ({_RAW}) z")
    soft = blur(radius).replace(_RAW, spread)
    own = ADAPTIVE.replace("greatest(32, least(128, trunc((max(r) + 1) / 74.0::DOUBLE * 3)::INT)) AS tile", f"{tile} AS tile")
    return morph(kinds).replace(STEPS["fx_bin"], own.replace(_RAW, soft))
