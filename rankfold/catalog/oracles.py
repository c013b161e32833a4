"""SQL for the queries, as a second formulation that another engine can run on the same tables.

Iterations are written out step by step. With one or two sketch columns the factorisations have
closed forms: the triangular factor of a 2 x 2 Gram matrix and the eigenvalues of another.
"""

from __future__ import annotations

PURCHASES = """y AS (SELECT o_custkey AS row_id, l_partkey AS col_id, SUM(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

EMBEDDINGS = """y AS (SELECT vec_id AS row_id, p AS col_id, CAST(embedding[p + 1] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, UNNEST(range(len(embedding))) AS p FROM embeddings))"""

_LINE_KEY = "concat_ws('/', l_orderkey, l_linenumber, printf('%.2f', l_extendedprice))"
LINES = "y AS (" + " UNION ALL ".join(
    f"SELECT {_LINE_KEY} AS row_id, CAST({j} AS BIGINT) AS col_id, CAST({c} AS DOUBLE) AS value FROM lineitem WHERE {c} <> 0"
    for j, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
) + ")"

EVENTS = """kinds AS (SELECT event_type, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS col_id
  FROM (SELECT DISTINCT event_type FROM events)),
y AS (SELECT user_id AS row_id, col_id, CAST(COUNT(*) AS DOUBLE) AS value
  FROM events JOIN kinds USING (event_type) GROUP BY 1, 2)"""


def size(rows: str = "COUNT(DISTINCT row_id)") -> str:
    return f"n AS (SELECT CAST({rows} AS DOUBLE) AS n_rows, MAX(col_id) + 1 AS n_cols FROM y)"


def mu() -> str:
    return "mu AS (SELECT col_id, SUM(value) / (SELECT n_rows FROM n) AS mu FROM y GROUP BY col_id)"


def seed(width: int, name: str = "w") -> str:
    """All matrix columns with the values (i + j) mod 10 + 1."""
    cols = ", ".join(f"CAST((p + {j}) % 10 + 1 AS DOUBLE) AS w{j}" for j in range(width))
    return f"{name} AS (SELECT p AS col_id, {cols} FROM (SELECT UNNEST(range(n_cols)) AS p FROM n))"


def each(width: int, form: str) -> str:
    return ", ".join(form.format(j=j) for j in range(width))


def raw_sketch(width: int, w: str = "w", name: str = "z") -> str:
    return f"{name} AS (SELECT row_id, {each(width, 'SUM(value * w{j}) AS z{j}')} FROM y JOIN {w} USING (col_id) GROUP BY row_id)"


def mean_image(width: int, w: str = "w", name: str = "m") -> str:
    return f"{name} AS (SELECT {each(width, 'SUM(mu * w{j}) AS m{j}')} FROM mu JOIN {w} USING (col_id))"


def centred_sketch(width: int, w: str = "w", tag: str = "") -> str:
    return (
        f"{mean_image(width, w, 'm' + tag)}, {raw_sketch(width, w, 'r' + tag)}, "
        f"z{tag} AS (SELECT row_id, {each(width, 'z{j} - m{j} AS z{j}')} FROM r{tag}, m{tag})"
    )


def cross(width: int, tag: str = "") -> str:
    return f"c{tag} AS (SELECT col_id, {each(width, 'SUM(value * z{j}) AS c{j}')} FROM y JOIN z{tag} USING (row_id) GROUP BY col_id)"


def gram(width: int, tag: str = "") -> str:
    """Upper triangle of the Gram matrix; rows that are not stored have the image -m."""
    cells = ", ".join(
        f"SUM(z{i} * z{j}) + (ANY_VALUE(n_rows) - COUNT(*)) * ANY_VALUE(m{i}) * ANY_VALUE(m{j}) AS g{i}{j}"
        for i in range(width) for j in range(i, width)
    )
    return f"g{tag} AS (SELECT {cells} FROM z{tag}, m{tag}, n)"


def triangular(width: int, tag: str = "") -> str:
    """Factor R of the Gram matrix, row by row."""
    steps, source = [], f"g{tag}"
    for i in range(width):
        less = " ".join(f"- r{k}{i} * r{k}{i}" for k in range(i))
        steps.append(f"d{tag}{i} AS (SELECT *, SQRT(g{i}{i} {less}) AS r{i}{i} FROM {source})")
        source = f"d{tag}{i}"
        if i + 1 < width:
            row = ", ".join(
                f"(g{i}{j} {' '.join(f'- r{k}{i} * r{k}{j}' for k in range(i))}) / r{i}{i} AS r{i}{j}" for j in range(i + 1, width)
            )
            steps.append(f"e{tag}{i} AS (SELECT *, {row} FROM {source})")
            source = f"e{tag}{i}"
    return ", ".join(steps) + f", f{tag} AS (SELECT * FROM {source})"


def orthonormal_step(width: int, w: str, tag: str, out: str) -> str:
    """``out[col_id, w0..]`` = A'Q, for every matrix column."""
    parts = [centred_sketch(width, w, tag), gram(width, tag), triangular(width, tag), cross(width, tag)]
    if width == 1:
        image = "c0 / r00 AS w0"
    else:
        image = "c0 / r00 AS w0, (c1 - c0 / r00 * r01) / r11 AS w1"
    parts.append(f"{out} AS (SELECT col_id, {image} FROM c{tag}, f{tag})")
    return ", ".join(parts)


def iterate(width: int, steps: int) -> str:
    """w0 is the seed, w{steps} the last A'Q."""
    return ", ".join([seed(width, "w0")] + [orthonormal_step(width, f"w{t}", f"t{t}", f"w{t + 1}") for t in range(steps)])


SIGMAS_2 = """h AS (SELECT SUM(w0 * w0) AS a, SUM(w0 * w1) AS b, SUM(w1 * w1) AS d FROM {w}),
s AS (SELECT SQRT((a + d) / 2 + SQRT(((a - d) / 2) * ((a - d) / 2) + b * b)) AS s0,
  SQRT((a + d) / 2 - SQRT(((a - d) / 2) * ((a - d) / 2) + b * b)) AS s1 FROM h)"""


def eigenvalues(width: int, source: str, sweeps: int = 5) -> str:
    """``eig[e]``: eigenvalues of the symmetric matrix in the one row g00, g01.. of ``source``, by cyclic Jacobi rotations."""
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]
    cell = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    steps = []
    for number, (p, q) in enumerate(pairs * sweeps):
        gap = f"(g{q}{q} - g{p}{p}) / (2 * g{p}{q})"
        tangent = f"CASE WHEN g{p}{q} = 0 THEN 0.0 ELSE (CASE WHEN {gap} < 0 THEN -1 ELSE 1 END) / (ABS({gap}) + SQRT({gap} * {gap} + 1)) END"
        turned = {cell(p, p): f"g{p}{p} - t * g{p}{q}", cell(q, q): f"g{q}{q} + t * g{p}{q}", cell(p, q): "0.0"}
        for k in set(range(width)) - {p, q}:
            turned[cell(k, p)] = f"({cell(k, p)} - t * {cell(k, q)}) / SQRT(t * t + 1)"
            turned[cell(k, q)] = f"(t * {cell(k, p)} + {cell(k, q)}) / SQRT(t * t + 1)"
        cells = ", ".join(f"{turned.get(cell(i, j), cell(i, j))} AS {cell(i, j)}" for i in range(width) for j in range(i, width))
        steps.append(f"t{number} AS MATERIALIZED (SELECT *, {tangent} AS t FROM {source})")
        steps.append(f"j{number} AS MATERIALIZED (SELECT {cells} FROM t{number})")
        source = f"j{number}"
    return ", ".join(steps) + ", eig AS (" + " UNION ALL ".join(f"SELECT g{i}{i} AS e FROM {source}" for i in range(width)) + ")"


def line_sigmas() -> str:
    """``ranked[comp, sigma]``: the singular values of the centred lines."""
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    return f"""{base(LINES)}, cell AS (SELECT r.row_id, mu.col_id, COALESCE(y.value, 0) - mu.mu AS a
    FROM (SELECT DISTINCT row_id FROM y) r CROSS JOIN mu LEFT JOIN y ON y.row_id = r.row_id AND y.col_id = mu.col_id),
  wide AS (SELECT row_id, {each(4, "SUM(a) FILTER (col_id = {j}) AS a{j}")} FROM cell GROUP BY row_id),
  g AS (SELECT {", ".join(f"SUM(a{i} * a{j}) AS g{i}{j}" for i, j in cells)} FROM wide), {eigenvalues(4, "g")},
  ranked AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY e DESC) - 1 AS INTEGER) AS comp, SQRT(e) AS sigma FROM eig)"""


def base(matrix: str = PURCHASES, rows: str = "COUNT(DISTINCT row_id)") -> str:
    return f"WITH {matrix}, {size(rows)}, {mu()}"


def r(expr: str, digits: int, name: str) -> str:
    return f"ROUND({expr}, {digits}) + 0.0 AS {name}"


def rs(prefix: str, width: int, digits: int) -> str:
    return ", ".join(r(f"{prefix}{j}", digits, f"{prefix}{j}") for j in range(width))


def _residual(steps: int, scale: str) -> str:
    """Iterations with W kept out of v: W0 = W - v (v.W); A'Q is deflated as well."""
    parts = [
        seed(4, "sd"),
        "vn AS (SELECT SQRT(SUM(w3 * w3)) AS vn FROM sd)",
        f"v AS (SELECT col_id, w3 / vn * {scale} AS v FROM sd, vn)",
        "o0 AS (SELECT SUM(v * w0) AS o FROM v JOIN sd USING (col_id))",
        "w0 AS (SELECT col_id, w0 - v * o AS w0 FROM sd JOIN v USING (col_id), o0)",
    ]
    for t in range(steps):
        parts.append(orthonormal_step(1, f"w{t}", f"t{t}", f"b{t}"))
        parts.append(f"p{t} AS (SELECT SUM(v * w0) AS o FROM v JOIN b{t} USING (col_id))")
        parts.append(f"q{t} AS (SELECT v.col_id, COALESCE(w0, 0.0) - v * o AS w0 FROM v LEFT JOIN b{t} ON v.col_id = b{t}.col_id, p{t})")
        parts.append(f"k{t} AS (SELECT SUM(v * w0) AS o FROM v JOIN q{t} USING (col_id))")
        parts.append(f"w{t + 1} AS (SELECT q{t}.col_id, w0 - v * o AS w0 FROM q{t} JOIN v ON q{t}.col_id = v.col_id, k{t})")
    parts.append(f"norm AS (SELECT SQRT(SUM(w0 * w0)) AS norm FROM q{steps - 1})")
    return base() + ", " + ", ".join(parts)


def _ppca(rounds: int) -> str:
    parts = [
        "f2 AS (SELECT SUM(VAR_POP_N + n_c * (a - mu) * (a - mu) + (n_rows - n_c) * mu * mu) AS norm2 FROM (SELECT col_id, VAR_POP(value) * COUNT(*) AS VAR_POP_N, COUNT(*) AS n_c, AVG(value) AS a FROM y GROUP BY col_id) JOIN mu USING (col_id), n)",
        seed(1, "c0"),
        "s0 AS (SELECT 0.9644868606768501 AS ss, SUM(w0 * w0) AS cc FROM c0)",
    ]
    for t in range(rounds):
        parts += [
            f"sx{t} AS (SELECT ss, 1.0 / (cc + ss) AS sx FROM s{t})",
            f"m{t} AS (SELECT col_id, w0 * sx AS w0 FROM c{t}, sx{t})",
            f"xm{t} AS (SELECT SUM(mu * w0) AS xm FROM mu JOIN m{t} USING (col_id))",
            f"x{t} AS (SELECT row_id, SUM(value * w0) - ANY_VALUE(xm) AS x FROM y JOIN m{t} USING (col_id), xm{t} GROUP BY row_id)",
            f"xx{t} AS (SELECT SUM(x * x) + ANY_VALUE(ss) * ANY_VALUE(sx) AS xx FROM x{t}, sx{t})",
            f"yx{t} AS (SELECT col_id, SUM(value * x) AS yx FROM y JOIN x{t} USING (row_id) GROUP BY col_id)",
            f"c{t + 1} AS (SELECT col_id, yx / xx AS w0 FROM yx{t}, xx{t})",
            f"s{t + 1} AS (SELECT (ANY_VALUE(norm2) + ANY_VALUE(xx) * SUM(w0 * w0) - 2 * SUM(w0 * yx)) / (ANY_VALUE(n_rows) * ANY_VALUE(n_cols)) AS ss, SUM(w0 * w0) AS cc FROM c{t + 1} JOIN yx{t} USING (col_id), xx{t}, f2, n)",
        ]
    return base() + ", " + ", ".join(parts)


_PARTS = "v AS (SELECT p_partkey AS col_id, CAST(p_size AS DOUBLE) AS v0, p_retailprice AS v1 FROM part)"
_LONG_PARTS = f"""{_PARTS}, l AS (SELECT col_id, 0 AS comp, v0 AS loading FROM v
  UNION ALL SELECT col_id, 1, v1 FROM v)"""
_DENSE_EVENTS = "d AS (SELECT row_id, col_id, COALESCE(value, 0.0) AS value FROM (SELECT DISTINCT row_id FROM y) CROSS JOIN (SELECT col_id FROM kinds) LEFT JOIN y USING (row_id, col_id))"
_RECONSTRUCTED = f"{raw_sketch(2)}, xh AS (SELECT row_id, col_id, z0 * w0 + z1 * w1 AS xhat FROM z CROSS JOIN w)"
_S2 = f"{base()}, {seed(2)}, {centred_sketch(2)}"
_S3 = f"{base()}, {seed(3)}, {centred_sketch(3)}"


def _pairs(width: int, form: str, digits: int | None = None) -> str:
    """The upper triangle as (i, j, g) rows."""
    rows = []
    for i in range(width):
        for j in range(i, width):
            value = form.format(i=i, j=j)
            value = r(value, digits, "g") if digits is not None else f"{value} AS g"
            rows.append(f"SELECT {i} AS i, {j} AS j, {value} FROM g, n")
    return " UNION ALL ".join(rows)


def unit(*keys: str) -> str:
    """The hash of keys as a number in (0, 1)."""
    text = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def normal(key: str, j: int, number: int = 7) -> str:
    return f"(SQRT(-2.0 * LN({unit(key, j, number, 1)})) * COS(2.0 * PI() * {unit(key, j, number, 2)}))"


_UNIFORM = "ROUND(" + unit("i", "{j}", "7", "0") + ", 12) AS w{j}"
_LARGEST = """t AS (SELECT SUM(err) AS err, SUM(a) AS a FROM e GROUP BY col_id)
SELECT ROUND(MAX(err), 4) AS err, ROUND(MAX(a), 4) AS norm, ROUND(MAX(err) / MAX(a), 8) AS ratio FROM t"""


def _lost() -> str:
    """The centred matrix less its projection on the unit vector along the first seed column."""
    return f"""{seed(1, "sd")}, w AS (SELECT col_id, w0 / (SELECT SQRT(SUM(w0 * w0)) FROM sd) AS w0 FROM sd), {centred_sketch(1)},
  e AS (SELECT w.col_id, ABS(z0 * w0 - COALESCE(value, 0.0) + mu) AS err, ABS(COALESCE(value, 0.0) - mu) AS a
    FROM z CROSS JOIN w JOIN mu USING (col_id) LEFT JOIN y ON y.row_id = z.row_id AND y.col_id = w.col_id), {_LARGEST}"""


def statements() -> dict[str, str]:
    purchases = f"WITH {PURCHASES}"
    out = {
        "coo_from_orders": f"{purchases} SELECT row_id, col_id, value FROM y",
        "dense_to_coo": f"WITH {EMBEDDINGS} SELECT * FROM y WHERE value <> 0",
        "ml_vectors": f"WITH {EMBEDDINGS} SELECT * FROM y WHERE value <> 0",
        "columns_to_coo": f"WITH {LINES} SELECT * FROM y",
        "event_counts": f"WITH {EVENTS} SELECT * FROM y",
        "stored_matrix": f"{purchases} SELECT * FROM y",
        "dims": f"{purchases} SELECT COUNT(*) AS nnz, COUNT(DISTINCT row_id) AS n_rows, MAX(col_id) + 1 AS n_cols FROM y",
        "coo_clean": """SELECT l_orderkey AS row_id, l_partkey AS col_id,
  SUM(CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END) AS value
  FROM lineitem WHERE l_partkey + 1 <= 1000 GROUP BY 1, 2
  HAVING SUM(CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END) <> 0""",
        "coo_roundtrip": f"{purchases} SELECT * FROM y",
        "dense_roundtrip": f"WITH {EMBEDDINGS} SELECT DENSE_RANK() OVER (ORDER BY row_id) - 1 AS row_id, col_id, value FROM y",
        "dense_rows": f"""WITH {EVENTS}, {_DENSE_EVENTS}
  SELECT row_id, STRING_AGG(printf('%.1f ', value), '' ORDER BY col_id) AS value FROM d GROUP BY row_id""",
        "lil_rows": f"""{purchases} SELECT c_custkey AS row_id,
  '{{' || COALESCE(STRING_AGG(col_id || ':' || printf('%.1f', value), ',' ORDER BY col_id), '') || '}}' AS value
  FROM customer LEFT JOIN y ON c_custkey = row_id GROUP BY c_custkey""",
        "components_roundtrip": f"WITH {_LONG_PARTS} SELECT DENSE_RANK() OVER (ORDER BY col_id) - 1 AS col_id, comp, loading FROM l",
        "leading_components": f"WITH {_LONG_PARTS} SELECT DENSE_RANK() OVER (ORDER BY col_id) - 1 AS col_id, comp, loading FROM l WHERE comp < 1",
        "run_metrics_avg": f"""SELECT event_type AS app, CAST(user_id AS VARCHAR) AS dataset, {r('AVG(value)', 6, 'avg_sketch_sec')},
  {r('SUM(value)', 6, 'total_sketch_sec')}, COUNT(value) AS n_iter FROM events GROUP BY 1, 2""",
        "in_range_entries": """SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS col_id, l_discount AS value
  FROM lineitem WHERE l_linenumber >= 0 AND l_linenumber < 6 AND l_discount <> 0""",
        "sampled_rows": f"{purchases} SELECT * FROM y WHERE {unit('row_id', '3')} < 0.1",
        "sampled_rows_modular": f"{purchases} SELECT * FROM y WHERE (row_id * 2654435761) % 1000 < 100",
        "sampled_rows_exact": f"""{purchases} SELECT y.* FROM y SEMI JOIN (SELECT row_id FROM (SELECT DISTINCT row_id FROM y)
  ORDER BY {unit('row_id', '3')}, row_id LIMIT 100) s USING (row_id)""",
        "seed_uniform": f"SELECT i AS col_id, {each(4, _UNIFORM)} FROM (SELECT UNNEST(range(COUNT(*))) AS i FROM part)",
        "seed_normal": f"SELECT i AS col_id, {', '.join(r(normal('i', j), 9, f'w{j}') for j in range(4))} FROM (SELECT UNNEST(range(COUNT(*))) AS i FROM part)",
        "sketch_normal": f"""{purchases}, w AS (SELECT col_id, {', '.join(f"{normal('col_id', j)} AS w{j}" for j in range(2))} FROM (SELECT DISTINCT col_id FROM y)),
  {raw_sketch(2)} SELECT row_id, {rs('z', 2, 6)} FROM z""",
        "deflated_parts": """WITH w AS (SELECT p_partkey AS col_id, CAST(p_size AS DOUBLE) AS w0, p_retailprice AS w1 FROM part),
  l AS (SELECT SQRT(SUM((w0 + w1) * (w0 + w1))) AS l FROM w), v AS (SELECT *, (w0 + w1) / l AS v0 FROM w, l),
  o AS (SELECT SUM(v0 * w0) AS o0, SUM(v0 * w1) AS o1 FROM v)
  SELECT col_id, ROUND(w0 - v0 * o0, 6) + 0.0 AS w0, ROUND(w1 - v0 * o1, 6) + 0.0 AS w1 FROM v, o""",
        "matrix_sum": f"""WITH {EMBEDDINGS}, d AS (SELECT MAX(col_id) AS d FROM y)
  SELECT 0 AS row, CAST(col_id AS INTEGER) AS pos, {r('SUM(value)', 6, 'total')} FROM y GROUP BY col_id
  UNION ALL SELECT 1, CAST(d - col_id AS INTEGER), {r('SUM(2 * value)', 6, 'total')} FROM y, d GROUP BY d - col_id""",
        "rdd_vectors": f"WITH {EMBEDDINGS} SELECT DENSE_RANK() OVER (ORDER BY row_id) - 1 AS row_id, col_id, value FROM y WHERE value <> 0",
        "row_matrix": f"{purchases} SELECT * FROM y",
        "stored_vectors": f"WITH {EMBEDDINGS} SELECT * FROM y WHERE value <> 0",
        "sketch_spread": f"{base(EVENTS)}, {seed(3)}, {raw_sketch(3)} SELECT * FROM z",
        "cross_spread": f"{base()}, {seed(3)}, {raw_sketch(3)}, {cross(3)} SELECT * FROM c",
        "reconstruction_error_ratio": f"""{_S2}, e AS (SELECT w.col_id, ABS((z0 / 977.0) * (w0 / 13.0) + (z1 / 977.0) * (w1 / 13.0) - COALESCE(value, 0.0) + mu) AS err,
  ABS(COALESCE(value, 0.0) - mu) AS a FROM z CROSS JOIN w JOIN mu USING (col_id) LEFT JOIN y ON y.row_id = z.row_id AND y.col_id = w.col_id), {_LARGEST}""",
        "reconstruction_error_entries": f"{base()}, {_lost()}",
        "reconstruction_error_vectors": f"{base(EMBEDDINGS)}, {_lost()}",
        "centred_entries": f"{base()} SELECT row_id, col_id, {r('value - mu', 6, 'value')} FROM y JOIN mu USING (col_id)",
        "centred_dense": f"{base(EVENTS)}, {_DENSE_EVENTS} SELECT row_id, col_id, {r('value - mu', 6, 'value')} FROM d JOIN mu USING (col_id)",
        "col_means": f"{base()} SELECT col_id, SUM(value) AS total, {r('ANY_VALUE(mu)', 8, 'mu')} FROM y JOIN mu USING (col_id) GROUP BY col_id",
        "mean_image": f"{base()}, {seed(3)}, {mean_image(3)} SELECT {rs('m', 3, 6)} FROM m",
        "sketch_raw": f"{base()}, {seed(3)}, {raw_sketch(3)} SELECT * FROM z",
        "sketch_wide": f"{base()}, {seed(18)}, {raw_sketch(18)} SELECT row_id, z0, z9, z16, z17 FROM z",
        "cross_raw": f"{base()}, {seed(3)}, {raw_sketch(3)}, {cross(3)} SELECT * FROM c",
        "sketch_sum": f"{base()}, {seed(3)}, {raw_sketch(3)} SELECT {each(3, 'SUM(z{j}) AS z{j}')} FROM z",
        "gram_raw": f"""{base()}, {seed(3)}, {raw_sketch(3)},
  g AS (SELECT {', '.join(f'SUM(z{i} * z{j}) AS g{i}{j}' for i in range(3) for j in range(i, 3))} FROM z) {_pairs(3, 'g{i}{j}')}""",
        "gram_wide": f"""WITH {EMBEDDINGS} SELECT CAST(a.col_id AS INTEGER) AS i, CAST(b.col_id AS INTEGER) AS j,
  {r('SUM(a.value * b.value)', 6, 'g')} FROM y a JOIN y b ON a.row_id = b.row_id AND a.col_id <= b.col_id GROUP BY 1, 2""",
        "sketch_centred": f"{_S3} SELECT row_id, {rs('z', 3, 5)} FROM z",
        "gram_centred": f"{_S3}, {gram(3)} {_pairs(3, 'g{i}{j} / n_rows', 4)}",
        "cross_centred": f"{_S3}, {cross(3)} SELECT col_id, {rs('c', 3, 3)} FROM c",
        "mean_corrected_cross": f"""{base()}, {seed(2)}, {raw_sketch(2)}, {cross(2)}, t AS (SELECT {each(2, 'SUM(z{j}) AS t{j}')} FROM z)
  SELECT col_id, {', '.join(r(f'c{j} - mu * t{j}', 3, f'c{j}') for j in range(2))} FROM c JOIN mu USING (col_id), t""",
        "absolute_column_norm": f"""{base(LINES)} SELECT {r('MAX(s)', 1, 'norm1')}
  FROM (SELECT SUM(ABS(value - mu)) AS s FROM y JOIN mu USING (col_id) GROUP BY col_id)""",
        "absolute_entry_norm": f"""{base(EVENTS)} SELECT {r('MAX(s)', 4, 'norm1')}
  FROM (SELECT SUM(ABS(value - mu)) AS s FROM y JOIN mu USING (col_id) GROUP BY col_id)""",
        "embedding_sum": f"WITH {EMBEDDINGS} SELECT CAST(col_id AS INTEGER) AS pos, {r('SUM(value)', 6, 'total')} FROM y GROUP BY col_id",
        "tsqr_r": f"{_S3}, {gram(3)}, {triangular(3)} " + " UNION ALL ".join(
            "SELECT " + ", ".join(r(f"r{i}{j}", 4, f"r{j}") if j >= i else f"0.0 AS r{j}" for j in range(3)) + " FROM f" for i in range(3)
        ),
        "orthonormal_image": f"{base()}, {seed(2)}, {orthonormal_step(2, 'w', 'x', 'b')} SELECT col_id, {r('w0', 6, 'b0')}, {r('w1', 6, 'b1')} FROM b",
        "deflated_seed": f"""{base()}, {seed(4)}, o AS (SELECT SUM(w3 / 100.0 * w0) AS o0, SUM(w3 / 100.0 * w1) AS o1 FROM w)
  SELECT col_id, {r('w0 - w3 / 100.0 * o0', 6, 'w0')}, {r('w1 - w3 / 100.0 * o1', 6, 'w1')} FROM w, o""",
        "orthonormalise_cholesky": f"""WITH {_PARTS}, g AS (SELECT SUM(v0 * v0) AS g00, SUM(v0 * v1) AS g01, SUM(v1 * v1) AS g11 FROM v),
  {triangular(2)} SELECT col_id, {r('v0 / r00', 8, 'u0')}, {r('(v1 - v0 / r00 * r01) / r11', 8, 'u1')} FROM v, f""",
        "orthonormalise_svd": f"""WITH {_PARTS}, h AS (SELECT SUM(v0 * v0) AS a, SUM(v0 * v1) AS b, SUM(v1 * v1) AS d FROM v),
  s AS (SELECT *, (a + d) / 2 + SQRT(((a - d) / 2) * ((a - d) / 2) + b * b) AS l0, (a + d) / 2 - SQRT(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1 FROM h),
  u AS (SELECT col_id, 0 AS comp, (v0 * b + v1 * (l0 - a)) / SQRT(b * b + (l0 - a) * (l0 - a)) / SQRT(l0) AS u FROM v, s
    UNION ALL SELECT col_id, 1, (v0 * b + v1 * (l1 - a)) / SQRT(b * b + (l1 - a) * (l1 - a)) / SQRT(l1) FROM v, s),
  k AS (SELECT comp, u AS lead FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY comp ORDER BY ABS(u) DESC, col_id) AS rn FROM u) WHERE rn = 1)
  SELECT col_id, comp, {r('u * SIGN(lead)', 7, 'loading')} FROM u JOIN k USING (comp)""",
        "kth_column_total": f"WITH {EVENTS}, t AS (SELECT col_id, SUM(value) AS s FROM y GROUP BY col_id) SELECT s AS sigma FROM t ORDER BY s DESC LIMIT 1 OFFSET 2",
        "kth_of_too_few": f"WITH {EVENTS}, t AS (SELECT col_id, SUM(value) AS s FROM y GROUP BY col_id) SELECT CASE WHEN COUNT(*) >= 99 THEN MIN(s) END AS sigma FROM t",
        "sparse_vectors": f"{purchases} SELECT * FROM y",
        "sketch_rows_layout": f"{base()}, {seed(3)}, {raw_sketch(3)} SELECT * FROM z",
        "sketch_grid_layout": f"{base()}, {seed(3)}, {raw_sketch(3)} SELECT * FROM z",
        "line_spectrum": f"{line_sigmas()} SELECT comp, {r('sigma', 3, 'sigma')} FROM ranked WHERE comp < 3",
        "kth_sigma_lines_k3": f"{line_sigmas()} SELECT 3 AS k, {r('sigma', 3, 'sigma')} FROM ranked WHERE comp = 2",
        "event_spectrum": f"""{base(EVENTS)}, cell AS (SELECT r.row_id, mu.col_id, COALESCE(y.value, 0) - mu.mu AS a
    FROM (SELECT DISTINCT row_id FROM y) r CROSS JOIN mu LEFT JOIN y ON y.row_id = r.row_id AND y.col_id = mu.col_id),
  g AS (SELECT p.col_id AS i, q.col_id AS j, SUM(p.a * q.a) AS g FROM cell p JOIN cell q USING (row_id) GROUP BY 1, 2)
  SELECT SUM(CASE WHEN i = j THEN 1 ELSE 0 END)::BIGINT AS n_sigma, ROUND(SUM(CASE WHEN i = j THEN g ELSE 0 END), 3) AS trace,
  ROUND(SUM(g * g) / 1000, 2) AS trace_of_square FROM g""",
        "projection_lil": f"""WITH {EVENTS}, s AS (SELECT row_id, col_id, CASE WHEN value > 30 THEN value ELSE 0 END AS v FROM y WHERE col_id < 2),
  l AS (SELECT '{{' || COALESCE(STRING_AGG(col_id || ':' || CAST(CAST(v AS DOUBLE) AS VARCHAR), ',' ORDER BY col_id) FILTER (WHERE v <> 0), '') || '}}' AS value FROM s GROUP BY row_id)
  SELECT value, COUNT(*) AS n FROM l GROUP BY 1""",
        "seed_validation": f"SELECT i AS col_id, {each(10, 'CAST((i + {j}) % 10 + 1 AS DOUBLE) AS w{j}')} FROM (SELECT UNNEST(range(COUNT(*))) AS i FROM part)",
        "project_centred": f"{_S2} " + " UNION ALL ".join(f"SELECT row_id, {j} AS comp, {r(f'z{j}', 5, 'score')} FROM z" for j in range(2)),
        "reconstruct_events": f"{base(EVENTS)}, {seed(2)}, {_RECONSTRUCTED} SELECT * FROM xh",
        "residual_events": f"""{base(EVENTS)}, {seed(2)}, {_RECONSTRUCTED} SELECT row_id, col_id, {r('xhat - COALESCE(value, 0.0) - mu', 6, 'value')}
  FROM xh LEFT JOIN y USING (row_id, col_id) JOIN mu USING (col_id)""",
        "reconstruction_error_columns": f"""{_S2}, e AS (SELECT z.row_id, w.col_id, mu, (z0 / 977.0) * (w0 / 13.0) + (z1 / 977.0) * (w1 / 13.0) AS xhat
    FROM z CROSS JOIN w JOIN mu ON w.col_id = mu.col_id)
  SELECT col_id, {r('SUM(ABS(xhat - (COALESCE(value, 0.0) - mu)))', 4, 'err')}, {r('SUM(ABS(COALESCE(value, 0.0) - mu))', 4, 'norm')}
  FROM e LEFT JOIN y USING (row_id, col_id) GROUP BY col_id""",
        "variance_term": f"""{_S2}, {cross(2)}, yc AS (SELECT row_id, SUM(value * c0) AS q0, SUM(value * c1) AS q1 FROM y JOIN c USING (col_id) GROUP BY row_id),
  mc AS (SELECT SUM(mu * c0) AS k0, SUM(mu * c1) AS k1 FROM mu JOIN c USING (col_id))
  SELECT {r('SUM(z0 * (q0 - k0) + z1 * (q1 - k1)) / 1e12', 3, 'term')} FROM z JOIN yc USING (row_id), mc""",
        "power_step_k1": f"{base()}, {iterate(1, 1)} SELECT 1 AS k, {r('SQRT(SUM(w0 * w0))', 5, 'sigma')}, 1 AS iterations FROM w1",
        "power_3_steps_k1": f"{base()}, {iterate(1, 3)} SELECT 1 AS k, {r('SQRT(SUM(w0 * w0))', 5, 'sigma')}, 3 AS iterations FROM w3",
        "power_3_steps_k2": f"{base()}, {iterate(2, 3)}, {SIGMAS_2.format(w='w3')} SELECT 2 AS k, {r('s1', 5, 'sigma')}, 3 AS iterations FROM s",
        "power_3_steps_vectors": f"{base(EMBEDDINGS)}, {iterate(2, 3)}, {SIGMAS_2.format(w='w3')} SELECT 2 AS k, {r('s1', 6, 'sigma')}, 3 AS iterations FROM s",
        "sketch_vectors": f"{base(EMBEDDINGS)}, {seed(3)}, {raw_sketch(3)} SELECT row_id, {rs('z', 3, 6)} FROM z",
        "pca_component_k1": f"""{base()}, {iterate(1, 3)}, k AS (SELECT w0 AS lead FROM w3 ORDER BY ABS(w0) DESC, col_id LIMIT 1),
  s AS (SELECT SQRT(SUM(w0 * w0)) AS s FROM w3)
  SELECT i.col_id, 0 AS comp, {r('COALESCE(w3.w0, 0.0) / s * SIGN(lead)', 7, 'loading')} FROM w0 i LEFT JOIN w3 ON i.col_id = w3.col_id, k, s""",
        "pca_sigmas_k2": f"{base()}, {iterate(2, 4)}, {SIGMAS_2.format(w='w4')} SELECT 0 AS comp, {r('s0', 5, 'sigma')} FROM s UNION ALL SELECT 1, {r('s1', 5, 'sigma')} FROM s",
        "pca_absent_rows": f"{base(rows='2 * COUNT(DISTINCT row_id)')}, {iterate(2, 2)}, {SIGMAS_2.format(w='w2')} SELECT 0 AS comp, {r('s0', 5, 'sigma')} FROM s UNION ALL SELECT 1, {r('s1', 5, 'sigma')} FROM s",
        "residual_norm_k1": f"{_residual(3, '1.0')} SELECT {r('norm', 5, 'norm')}, 3 AS iterations FROM norm",
        "residual_norm_as_given": f"{_residual(2, '0.5')} SELECT {r('norm', 5, 'norm')}, 2 AS iterations FROM norm",
        "relative_error_k1": f"{_residual(3, '1.0')} SELECT {r('norm', 5, 'norm')}, CAST(350.0 AS DOUBLE) AS sigma_k1, {r('(norm - 350.0) / 350.0', 8, 'error')} FROM norm",
        "ppca_variance_k1": f"{_ppca(2)} SELECT {r('ss', 7, 'variance')}, 2 AS rounds FROM s2",
        "ppca_component_k1": f"{_ppca(2)} SELECT c0.col_id, 0 AS comp, {r('COALESCE(c2.w0, 0.0)', 5, 'loading')} FROM c0 LEFT JOIN c2 ON c0.col_id = c2.col_id",
    }
    for name, rows in [("frobenius_norm", "COUNT(DISTINCT row_id)"), ("frobenius_norm_absent_rows", "2 * COUNT(DISTINCT row_id)")]:
        out[name] = f"""{base(rows=rows)} SELECT {r('SUM(p)', 4, 'norm2')} FROM (
  SELECT SUM((value - mu) * (value - mu)) + (ANY_VALUE(n_rows) - COUNT(*)) * ANY_VALUE(mu) * ANY_VALUE(mu) AS p
  FROM y JOIN mu USING (col_id), n GROUP BY col_id)"""
    projected = " UNION ALL ".join(f"SELECT row_id, {j} AS comp, z{j} AS score FROM z WHERE z{j} <> 0" for j in range(2))
    centred = " UNION ALL ".join(f"SELECT row_id, {j} AS comp, {r(f'z{j}', 5, 'score')} FROM z" for j in range(2))
    out["project_rows"] = out["project_grid"] = f"{_S2} {centred}"
    out["project_vectors"] = f"{base(EMBEDDINGS)}, {seed(2)}, {centred_sketch(2)} {centred}"
    for name in ("project_validation", "projection_file"):
        out[name] = f"{base()}, {seed(2)}, {raw_sketch(2)} {projected}"
    return out
