"""Plain SQL for every query, with the iterations written out step by step."""

from __future__ import annotations

from collections.abc import Sequence

from catalog.views import THREE, TWO


class Ctes:
    """Collects named subqueries; each is computed once."""

    def __init__(self):
        self.items: list[tuple[str, str]] = []

    def add(self, name: str, sql: str) -> str:
        self.items.append((name, sql))
        return name

    def query(self, final: str) -> str:
        body = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in self.items)
        return f"WITH RECURSIVE {body}\n{final}"


def raw_embeddings(parts: Sequence[tuple[int, int]]) -> str:
    """Long cells (v, r, f, x) of the embedding views."""
    view = " ".join(f"WHEN c < {s + n} THEN {i}" for i, (s, n) in enumerate(parts))
    start = " ".join(f"WHEN c < {s + n} THEN {s}" for s, n in parts)
    total = sum(n for _, n in parts)
    return (
        f"SELECT CASE {view} END v, r, c - CASE {start} END f, x FROM "
        "(SELECT vec_id r, generate_subscripts(embedding, 1) - 1 c, unnest(embedding)::DOUBLE x "
        f"FROM embeddings) t WHERE c < {total}"
    )


REVENUE = (
    "SELECT o_custkey r, p_brand, p_type, sum(l_extendedprice * (1 - l_discount)) rev "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
    "GROUP BY ALL"
)


def customer_ctes(c: Ctes) -> str:
    c.add("rev", REVENUE)
    c.add("brands", "SELECT p_brand n, row_number() OVER (ORDER BY p_brand) - 1 f FROM (SELECT DISTINCT p_brand FROM part)")
    c.add("types", "SELECT p_type n, row_number() OVER (ORDER BY p_type) - 1 f FROM (SELECT DISTINCT p_type FROM part)")
    c.add("prios", "SELECT o_orderpriority n, row_number() OVER (ORDER BY o_orderpriority) - 1 f "
                   "FROM (SELECT DISTINCT o_orderpriority FROM orders)")
    return c.add(
        "cust",
        "SELECT 0 v, r, f, sum(rev) x FROM rev JOIN brands ON p_brand = n GROUP BY r, f "
        "UNION ALL SELECT 1, r, f, sum(rev) FROM rev JOIN types ON p_type = n GROUP BY r, f "
        "UNION ALL SELECT 2, o_custkey, f, count(*)::DOUBLE FROM orders JOIN prios ON o_orderpriority = n "
        "GROUP BY o_custkey, f")


def customer_dense(c: Ctes) -> str:
    """Every (customer, feature) cell over the customers in all three views."""
    customer_ctes(c)
    c.add("ids", "SELECT r FROM cust GROUP BY r HAVING count(DISTINCT v) = 3")
    c.add("feats", "SELECT 0 v, f FROM brands UNION ALL SELECT 1, f FROM types UNION ALL SELECT 2, f FROM prios")
    return c.add(
        "dense",
        "SELECT feats.v, ids.r, feats.f, coalesce(x, 0) x FROM ids CROSS JOIN feats "
        "LEFT JOIN cust ON cust.v = feats.v AND cust.r = ids.r AND cust.f = feats.f")


def centred(c: Ctes, source: str, name: str = "x") -> str:
    return c.add(name, f"SELECT v, r, f, x - avg(x) OVER (PARTITION BY v, f) x FROM {source}")


def cca(c: Ctes, d: int, k: int, rhos: Sequence[float], steps: int, x: str = "x", p: str = "") -> None:
    """The whole fit on centred cells ``x(v, r, f, x)`` with a fixed number of steps.

    Adds ``{p}load(component, v, f, z)`` and ``{p}sig(component, vi, vj, s)``.
    """
    rhos = list(rhos) * d if len(rhos) == 1 else list(rhos)
    c.add(f"{p}cc", f"SELECT a.v vj, b.v vi, a.f j, b.f i, sum(a.x * b.x) c "
                    f"FROM {x} a JOIN {x} b ON a.r = b.r AND a.v <> b.v GROUP BY ALL")
    deflated = f"{p}cc"
    for q in range(k):
        t = f"{p}k{q}"
        if q:
            before = f"{p}k{q - 1}"
            reduce = ("SELECT d.vj, d.vi, d.j, d.i, d.c - coalesce(s.s * a.z * b.z, 0) c FROM {src} d "
                      f"JOIN {before}sig s ON s.vi = d.vi AND s.vj = d.vj "
                      f"LEFT JOIN {before}fin a ON a.v = d.vj AND a.f = d.j "
                      f"LEFT JOIN {before}fin b ON b.v = d.vi AND b.f = d.i")
            new = c.add(f"{t}d", reduce.format(src=deflated))
            refit = new if q == 1 else c.add(f"{t}b", reduce.format(src=f"{p}cc"))
            deflated = new
        else:
            refit = deflated
        for i in range(d):
            terms, norms = [], []
            for j in (j for j in range(d) if j != i):
                u = f"{t}p{i}{j}"
                only = f" AND j IN (SELECT f FROM {t}st{j})" if j < i else ""
                c.add(f"{u}a", f"SELECT j, i, c FROM {deflated} WHERE vj = {j} AND vi = {i}{only}")
                c.add(f"{u}m", f"SELECT i, sqrt(sum(c * c)) n FROM {u}a GROUP BY i ORDER BY 2 DESC, 1 LIMIT 1")
                c.add(f"{u}x0", f"SELECT j, c / n x FROM {u}a JOIN {u}m USING (i)")
                for s in range(steps):
                    c.add(f"{u}z{s}", f"SELECT i, sign(w) * greatest(0, abs(w) - {rhos[i]!r} * (SELECT n FROM {u}m)) z "
                                      f"FROM (SELECT i, sum(c * x) w FROM {u}a JOIN {u}x{s} USING (j) GROUP BY i)")
                    c.add(f"{u}y{s}", f"SELECT j, sum(c * z) y FROM {u}a JOIN {u}z{s} USING (i) GROUP BY j")
                    c.add(f"{u}x{s + 1}", f"SELECT j, y / (SELECT sqrt(sum(y * y)) FROM {u}y{s}) x FROM {u}y{s}")
                terms.append(f"SELECT i f, sum(c * x) w FROM {u}a JOIN {u}x{steps} USING (j) GROUP BY i")
                norms.append(f"(SELECT n FROM {u}m)")
            top = norms[0] if len(norms) == 1 else f"greatest({', '.join(norms)})"
            c.add(f"{t}t{i}", f"SELECT f, sum(w) w FROM ({' UNION ALL '.join(terms)}) GROUP BY f")
            c.add(f"{t}h{i}", f"SELECT f, sign(w) * greatest(0, abs(w) - {rhos[i]!r} * {top}) z FROM {t}t{i}")
            c.add(f"{t}st{i}", f"SELECT f, z / (SELECT sqrt(sum(z * z)) FROM {t}h{i}) z FROM {t}h{i} WHERE z <> 0")
        for i in range(d):
            prev = f"{t}st{i}"
            for s in range(steps):
                terms = []
                for j in (j for j in range(d) if j != i):
                    block = (f"(SELECT j, i, c FROM {refit} WHERE vj = {j} AND vi = {i} "
                             f"AND i IN (SELECT f FROM {t}st{i}) AND j IN (SELECT f FROM {t}st{j}))")
                    if j < i:
                        terms.append(f"SELECT i f, sum(c * z) t FROM {block} JOIN {t}fin{j} ON j = f GROUP BY i")
                    else:
                        v = c.add(f"{t}v{i}{j}{s}", f"SELECT j, sum(c * z) v FROM {block} JOIN {prev} ON i = f GROUP BY j")
                        terms.append(f"SELECT i f, sum(c * v) t FROM {block} b JOIN {v} USING (j) GROUP BY i")
                c.add(f"{t}r{i}{s}", f"SELECT f, sum(t) t FROM ({' UNION ALL '.join(terms)}) GROUP BY f")
                prev = c.add(f"{t}w{i}{s}", f"SELECT f, t / (SELECT sqrt(sum(t * t)) FROM {t}r{i}{s}) z FROM {t}r{i}{s}")
            c.add(f"{t}fin{i}", f"SELECT f, z FROM {prev}")
        c.add(f"{t}fin", " UNION ALL ".join(f"SELECT {i} v, f, z FROM {t}fin{i}" for i in range(d)))
        c.add(f"{t}sig", f"SELECT d.vi, d.vj, sum(d.c * a.z * b.z) s FROM {refit} d "
                         f"JOIN {t}fin a ON a.v = d.vj AND a.f = d.j JOIN {t}fin b ON b.v = d.vi AND b.f = d.i "
                         "GROUP BY d.vi, d.vj")
    c.add(f"{p}load", " UNION ALL ".join(
        f"SELECT {q} component, v, f, z FROM {p}k{q}fin WHERE z <> 0" for q in range(k)))
    c.add(f"{p}sig", " UNION ALL ".join(f"SELECT {q} component, vi, vj, s FROM {p}k{q}sig" for q in range(k)))


def soft(w: str, bound: str) -> str:
    return f"sign({w}) * greatest(0, abs({w}) - {bound})"


def until_settled(c: Ctes, name: str, start: str, step: str, tol: float) -> str:
    """Iterates (s, x, loss, done) from ``start``; ``step`` makes (s, x, loss, before) of the iterates that are not done.

    The last row is the first iterate, from the second on, whose loss is 0 or near the one before.
    """
    return c.add(name, f"SELECT 0 s, ({start}) x, NULL::DOUBLE loss, false done UNION ALL "
                       f"SELECT s + 1, x, loss, s >= 1 AND (loss = 0 OR abs(loss - before) <= {tol!r} * abs(before)) FROM ({step})")


def converged(c: Ctes, d: int, rho: float, tol: float = 1e-4, x: str = "x") -> None:
    """One component on centred cells, every iteration run to its stop rule; adds ``load``.

    Vectors are lists, so a step is a row of a recursive query; all losses are kept.
    """
    c.add("cc", f"SELECT a.v vj, b.v vi, a.f j, b.f i, sum(a.x * b.x) c FROM {x} a JOIN {x} b ON a.r = b.r AND a.v <> b.v GROUP BY ALL")
    for i in range(d):
        terms, norms = [], []
        for j in (j for j in range(d) if j != i):
            u = f"p{i}{j}"
            only = f" AND j IN (SELECT f FROM st{j})" if j < i else ""
            c.add(f"{u}a", f"SELECT j, i, c FROM cc WHERE vj = {j} AND vi = {i}{only}")
            c.add(f"{u}m", f"SELECT i, sqrt(sum(c * c)) n FROM {u}a GROUP BY i ORDER BY 2 DESC, 1 LIMIT 1")
            c.add(f"{u}r", f"SELECT list(row ORDER BY i) a, list(i ORDER BY i) ids FROM (SELECT i, list(c ORDER BY j) row FROM {u}a GROUP BY i)")
            c.add(f"{u}t", f"SELECT list(col ORDER BY j) b FROM (SELECT j, list(c ORDER BY i) col FROM {u}a GROUP BY j)")
            images = f"SELECT s, loss before, list_transform(a, lambda row: list_dot_product(row, x)) w FROM {u}it, {u}r WHERE NOT done"
            shrunk = f"SELECT s, before, list_transform(w, lambda e: {soft('e', f'{rho!r} * n')}) z FROM ({images}), {u}m"
            moved = f"SELECT s, before, list_dot_product(z, z) loss, list_transform(b, lambda col: list_dot_product(col, z)) y FROM ({shrunk}), {u}t"
            until_settled(c, f"{u}it", f"SELECT list(c / n ORDER BY j) FROM {u}a JOIN {u}m USING (i)",
                          f"SELECT s, before, loss, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) x FROM ({moved})", tol)
            terms.append(f"SELECT unnest(ids) f, unnest(list_transform(a, lambda row: list_dot_product(row, x))) w "
                         f"FROM {u}r, (SELECT x FROM {u}it ORDER BY s DESC LIMIT 1)")
            norms.append(f"(SELECT n FROM {u}m)")
        top = norms[0] if len(norms) == 1 else f"greatest({', '.join(norms)})"
        c.add(f"h{i}", f"SELECT f, {soft('w', f'{rho!r} * {top}')} z FROM (SELECT f, sum(w) w FROM ({' UNION ALL '.join(terms)}) GROUP BY f)")
        c.add(f"st{i}", f"SELECT f, z / (SELECT sqrt(sum(z * z)) FROM h{i}) z FROM h{i} WHERE z <> 0")
    for i in range(d):
        before = [f"SELECT i, sum(c * z) t FROM cc JOIN fin{j} ON j = f WHERE vi = {i} AND vj = {j} GROUP BY i" for j in range(i)]
        behind = (f"SELECT a.i, b.i i2, a.c * b.c t FROM cc a JOIN cc b USING (vi, vj, j) WHERE a.vi = {i} AND a.vj > {i} AND ("
                  + " OR ".join([f"(vj = {j} AND j IN (SELECT f FROM st{j}))" for j in range(i + 1, d)] or ["false"]) + ")")
        c.add(f"l{i}", f"SELECT list(t ORDER BY f) l FROM (SELECT f, coalesce(sum(t), 0) t FROM st{i} LEFT JOIN "
                       f"({' UNION ALL '.join(before) or 'SELECT 0 i, 0.0 t WHERE false'}) ON i = f GROUP BY f)")
        c.add(f"q{i}", f"SELECT list(row ORDER BY f) q, list(f ORDER BY f) ids FROM (SELECT f, list(t ORDER BY f2) row FROM ("
                       f"SELECT a.f, b.f f2, coalesce(sum(t), 0) t FROM st{i} a CROSS JOIN st{i} b LEFT JOIN ({behind}) ON i = a.f AND i2 = b.f "
                       "GROUP BY ALL) GROUP BY f)")
        sums = (f"SELECT s, loss before, list_transform(range(len(l)), lambda k: l[k + 1] + list_dot_product(q[k + 1], x)) t "
                f"FROM w{i}, l{i}, q{i} WHERE NOT done")
        until_settled(c, f"w{i}", f"SELECT list(z ORDER BY f) FROM st{i}",
                      "SELECT s, before, -2 * sqrt(list_dot_product(t, t)) loss, "
                      f"list_transform(t, lambda e: e / sqrt(list_dot_product(t, t))) x FROM ({sums})", tol)
        c.add(f"fin{i}", f"SELECT unnest(ids) f, unnest(x) z FROM q{i}, (SELECT x FROM w{i} ORDER BY s DESC LIMIT 1)")
    c.add("load", " UNION ALL ".join(f"SELECT 0 component, {i} v, f, z FROM fin{i} WHERE z <> 0" for i in range(d)))


LOADINGS = ("SELECT component::INTEGER component, v::INTEGER view_idx, f::BIGINT feature_id, "
            "round(z, 6) + 0.0 loading FROM load")


def embedding_fit(parts, k=1, rhos=(0.1,), steps=3) -> Ctes:
    c = Ctes()
    c.add("e", raw_embeddings(parts))
    centred(c, "e")
    cca(c, len(parts), k, rhos, steps)
    return c


def scores(c: Ctes, x: str = "x", load: str = "load", name: str = "s") -> str:
    return c.add(name, f"SELECT x.v, x.r, l.component q, sum(x.x * l.z) s FROM {x} x "
                       f"JOIN {load} l ON l.v = x.v AND l.f = x.f GROUP BY ALL")


def predictions(c: Ctes, x: str = "x", load: str = "load", s: str = "s", name: str = "pred") -> str:
    """One component: the other views' scores times the loading over its squared norm."""
    c.add(f"{name}n", f"SELECT v, sum(z * z) n FROM {load} GROUP BY v")
    c.add(f"{name}o", f"SELECT a.v, b.r, sum(b.s) s FROM (SELECT DISTINCT v FROM {x}) a JOIN {s} b ON a.v <> b.v GROUP BY ALL")
    return c.add(name, f"SELECT x.v, x.r, x.f, coalesce(o.s * l.z / n.n, 0) p FROM {x} x "
                       f"JOIN {name}o o ON o.v = x.v AND o.r = x.r JOIN {name}n n ON n.v = x.v "
                       f"LEFT JOIN {load} l ON l.v = x.v AND l.f = x.f")


def safe(corr: str) -> str:
    return f"CASE WHEN {corr} IS NULL OR isnan({corr}) THEN 0 ELSE {corr} END"


CELLS = "v::INTEGER view_idx, r::BIGINT row_id, f::BIGINT feature_id"


def cells_out(source: str, value: str = "x", digits: int = 6, where: str = "") -> str:
    return f"SELECT {CELLS}, round({value}, {digits}) + 0.0 AS value FROM {source} {where}"


def build() -> dict[str, str]:
    two, three = raw_embeddings(TWO), raw_embeddings(THREE)
    out: dict[str, str] = {}

    def put(name, final, *ctes, base=None):
        c = base or Ctes()
        for n, q in ctes:
            c.add(n, q)
        out[name] = c.query(final) if c.items else final

    e = ("e", two)
    x = ("x", "SELECT v, r, f, x - avg(x) OVER (PARTITION BY v, f) x FROM e")
    cc = ("cc", "SELECT a.f j, b.f i, sum(a.x * b.x) c FROM x a JOIN x b ON a.r = b.r "
                "WHERE a.v = 1 AND b.v = 0 GROUP BY ALL")
    mean = ("mean", "SELECT v, f, avg(x) m FROM e GROUP BY v, f")
    norm = ("norm", "SELECT v, f, sqrt(sum(x * x)) n FROM x GROUP BY v, f")

    # sources and reshapes
    put("view_cells_from_array", cells_out("e"), e)
    put("matrix_text_roundtrip", cells_out("e"), e)
    put("matrix_text_lines", cells_out("lines"), e,
        ("lines", "SELECT v, dense_rank() OVER (ORDER BY r) - 1 r, f, x FROM e WHERE v = 1"))
    out["view_cells_from_columns"] = (
        "SELECT 0::INTEGER view_idx, p_partkey::BIGINT row_id, 0::BIGINT feature_id, p_size::DOUBLE AS value FROM part "
        "UNION ALL SELECT 1, p_partkey, 0, p_retailprice FROM part")
    c = Ctes()
    customer_ctes(c)
    out["view_cells_from_pivot"] = c.query(cells_out("cust", digits=4))
    c = Ctes()
    customer_ctes(c)
    c.add("types_e", "SELECT event_type n, row_number() OVER (ORDER BY event_type) - 1 f FROM (SELECT DISTINCT event_type FROM events)")
    c.add("ev", "SELECT 0 v, user_id r, f, count(*)::DOUBLE x FROM events JOIN types_e ON event_type = n GROUP BY ALL "
                "UNION ALL SELECT 1, user_id, f, avg(value) FROM events JOIN types_e ON event_type = n GROUP BY ALL "
                "UNION ALL SELECT 2, r, f, x FROM cust WHERE v = 0")
    out["view_cells_matched"] = c.query(
        cells_out("ev", value="CASE WHEN v = 1 THEN round(x, 9) ELSE round(x, 4) END", digits=9, where="WHERE r IN (SELECT r FROM ev GROUP BY r HAVING count(DISTINCT v) = 3)"))
    c = Ctes()
    customer_dense(c)
    out["fill_missing_cells"] = c.query(cells_out("dense", digits=4))
    c = Ctes()
    c.add("w", "SELECT 0 v, doc_id r, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) t FROM documents")
    c.add("g", "SELECT 1 v, doc_id r, substr(lower(text), p::BIGINT, 3) t FROM documents, "
               "LATERAL (SELECT unnest(generate_series(1, length(lower(text)) - 2)) p)")
    c.add("n", "SELECT v, r, t, count(*)::DOUBLE n FROM (SELECT * FROM w WHERE t <> '' UNION ALL SELECT * FROM g) GROUP BY ALL")
    c.add("b", "SELECT v, r, ('0x' || substr(md5(t), 1, 8))::BIGINT % 16384 f, sum(n) x FROM n GROUP BY ALL")
    out["view_cells_from_documents"] = c.query(cells_out("b"))
    put("subject_index",
        "SELECT o_custkey::BIGINT row_id, (row_number() OVER (ORDER BY o_custkey) - 1)::BIGINT row_idx "
        "FROM (SELECT DISTINCT o_custkey FROM orders)")
    put("feature_vectors",
        "SELECT v::INTEGER view_idx, f::BIGINT feature_id, (idx // 256)::BIGINT chunk, "
        "list(round(x, 6) + 0.0 ORDER BY idx) vec FROM e JOIN ids USING (r) GROUP BY ALL",
        e, ("ids", "SELECT r, row_number() OVER (ORDER BY r) - 1 idx FROM (SELECT DISTINCT r FROM e)"))
    put("matrix_rows",
        "SELECT v::INTEGER view_idx, r::BIGINT row_id, (f // 20)::BIGINT chunk, "
        "list(round(x, 6) + 0.0 ORDER BY f) vec FROM e GROUP BY ALL", e)
    put("matrix_ordered", cells_out("e") + " ORDER BY 1, 2, 3", e)
    put("vector_table",
        "SELECT (row_number() OVER (ORDER BY l_linenumber) - 1)::BIGINT feature_id, round(q, 4) AS value "
        "FROM (SELECT l_linenumber, sum(l_quantity) q FROM lineitem GROUP BY 1)")
    put("lowrank_pattern",
        "SELECT v::INTEGER view_idx, r::BIGINT row_id, f::BIGINT feature_id, (u * w) + 0.0 AS value FROM ("
        "SELECT v, vec_id r, f, (vec_id % 7 - 3)::DOUBLE u, CASE WHEN f < h THEN 1.0 WHEN f < 2 * h THEN -1.0 ELSE 0.0 END w "
        "FROM embeddings CROSS JOIN (SELECT 0 v, unnest(generate_series(0, 39)) f, 4 h "
        "UNION ALL SELECT 1, unnest(generate_series(0, 29)), 6))")

    def gauss(*keys):
        uniform = [f"((('0x' || substr(md5(concat_ws(',', {', '.join(keys)}, {salt})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
                   for salt in (1, 2)]
        return f"sqrt(-2 * ln({uniform[0]})) * cos(2 * pi() * {uniform[1]})"

    put("lowrank_cells",
        "SELECT v::INTEGER view_idx, r::BIGINT row_id, f::BIGINT feature_id, round(u * (w + 0.1 * g), 6) + 0.0 AS value FROM ("
        f"SELECT v, vec_id r, f, {gauss('1', '-1', 'vec_id')} u, {gauss('1', 'v', 'f')} g, "
        "CASE WHEN f < h THEN 1.0 WHEN f < 2 * h THEN -1.0 ELSE 0.0 END w "
        "FROM embeddings CROSS JOIN (SELECT 0 v, unnest(generate_series(0, 39)) f, 4 h "
        "UNION ALL SELECT 1, unnest(generate_series(0, 29)), 6))")

    # projections, filters, scalars
    put("center_columns", cells_out("x"), e, x)
    c = Ctes()
    customer_dense(c)
    centred(c, "dense")
    out["center_customer_columns"] = c.query(cells_out("x", "x / 1009.0"))
    put("standardize_columns", cells_out("e JOIN mean USING (v, f) JOIN sd USING (v, f)", "(x - m) / s"),
        e, mean, ("sd", "SELECT v, f, stddev_pop(x) s FROM e GROUP BY v, f"))
    put("standardize_scalar", cells_out("e", "(x - 0.25) / 2.0"), e)
    put("scale_entries", cells_out("e", "x / 3.0"), e)
    put("soft_threshold",
        "SELECT v::INTEGER view_idx, f::BIGINT feature_id, round(sign(m) * greatest(0, abs(m) - 0.01), 6) + 0.0 AS value FROM mean",
        e, mean)
    put("get_column", f"SELECT v::INTEGER view_idx, r::BIGINT row_id, 0::BIGINT feature_id, round(x / 2.0, 6) + 0.0 AS value FROM e WHERE f = 9", e)
    put("get_columns",
        "SELECT v::INTEGER view_idx, r::BIGINT row_id, k::BIGINT feature_id, round(x / 2.0, 6) + 0.0 AS value "
        "FROM e JOIN (VALUES (9, 0), (3, 1), (9, 2), (30, 3)) t(f, k) USING (f)", e)
    put("restrict_support", cells_out("e JOIN big USING (v, f)"), e, mean,
        ("big", "SELECT v, f FROM mean WHERE abs(m) > 0.01"))
    put("l2_normalize",
        "SELECT v::INTEGER view_idx, f::BIGINT feature_id, round(m / sqrt(sum(m * m) OVER (PARTITION BY v)), 6) + 0.0 AS value FROM mean",
        e, mean)
    put("support", "SELECT v::INTEGER view_idx, f::BIGINT feature_id FROM mean WHERE abs(m) > 0.01", e, mean)

    # linear algebra
    put("left_multiply",
        "SELECT label::BIGINT out_row, f::BIGINT feature_id, round(sum(x), 6) + 0.0 AS value "
        "FROM e JOIN embeddings ON vec_id = r WHERE v = 0 GROUP BY ALL", e)
    put("cross_covariance",
        "SELECT j::BIGINT left_feature, i::BIGINT right_feature, round(c, 6) + 0.0 AS value FROM cc", e, x, cc)
    c = Ctes()
    customer_dense(c)
    out["cross_covariance_customers"] = c.query(
        "SELECT a.f::BIGINT left_feature, b.f::BIGINT right_feature, round(sum(a.x / 1000 * b.x), 4) + 0.0 AS value "
        "FROM dense a JOIN dense b ON a.r = b.r WHERE a.v = 0 AND b.v = 2 GROUP BY a.f, b.f")
    c = Ctes()
    customer_dense(c)
    centred(c, "dense")
    out["cross_covariance_centered"] = c.query(
        "SELECT a.f::BIGINT left_feature, b.f::BIGINT right_feature, round(sum(a.x / 1000 * b.x), 4) + 0.0 AS value "
        "FROM x a JOIN x b ON a.r = b.r WHERE a.v = 0 AND b.v = 2 GROUP BY a.f, b.f")
    put("matvec", "SELECT r::BIGINT row_id, round(sum(x * m), 6) + 0.0 AS value FROM e JOIN mean USING (v, f) WHERE v = 0 GROUP BY r",
        e, mean)
    put("matvec_t", "SELECT f::BIGINT feature_id, round(sum(x * label), 6) + 0.0 AS value FROM e JOIN embeddings ON vec_id = r "
                    "WHERE v = 0 GROUP BY f", e)
    put("subtract_outer",
        cells_out("e JOIN embeddings ON vec_id = r JOIN mean USING (v, f)", "x - label * m", where="WHERE v = 0"), e, mean)
    put("deflate_covariance",
        "SELECT j::BIGINT left_feature, i::BIGINT right_feature, round(c - 0.5 * a.m * b.m, 6) + 0.0 AS value "
        "FROM cc JOIN mean a ON a.v = 1 AND a.f = j JOIN mean b ON b.v = 0 AND b.f = i", e, x, cc, mean)
    c = embedding_fit(TWO, k=2)
    c.add("start", "SELECT f, x FROM (SELECT f, sqrt(sum(x * x)) x FROM x WHERE v = 1 GROUP BY f)")
    c.add("low", "SELECT l.component q, s.s * sum(l.z * start.x) w FROM load l JOIN start ON start.f = l.f "
                 "JOIN sig s ON s.component = l.component AND s.vi = 0 AND s.vj = 1 WHERE l.v = 1 GROUP BY l.component, s.s")
    c.add("high", "SELECT i f, sum(c * start.x) a FROM cc JOIN start ON start.f = j WHERE vj = 1 AND vi = 0 GROUP BY i")
    out["deflated_matvec"] = c.query(
        "SELECT f::BIGINT feature_id, round(a - coalesce((SELECT sum(w * z) FROM low JOIN load l ON l.component = q "
        "WHERE l.v = 0 AND l.f = high.f), 0), 6) + 0.0 AS value FROM high")

    # aggregates
    put("column_power_sums", "SELECT v::INTEGER view_idx, f::BIGINT feature_id, round(sum(x * x * x), 6) + 0.0 AS total FROM e GROUP BY v, f", e)
    top = ("top", "SELECT f, n FROM norm WHERE v = 0 ORDER BY n DESC, f LIMIT 1")
    put("max_l2_column", "SELECT round(n, 6) AS norm, f::BIGINT feature_id, r::BIGINT row_id, round(x, 6) + 0.0 AS value "
                         "FROM top JOIN x USING (f) WHERE v = 0", e, x, norm, top)
    put("max_l2_column_support",
        "SELECT round(n, 6) AS norm, f::BIGINT feature_id, r::BIGINT row_id, round(x, 6) + 0.0 AS value "
        "FROM top JOIN h USING (f)",
        e, x, ("h", "SELECT x.f, x.r, x.x FROM x JOIN embeddings ON vec_id = r WHERE v = 0 AND label > 0"),
        ("top", "SELECT f, sqrt(sum(x * x)) n FROM h GROUP BY f ORDER BY n DESC, f LIMIT 1"))
    c = Ctes()
    c.add("e", three)
    centred(c, "e")
    c.add("p", "SELECT b.v vi, a.v vj, b.f i, a.f j, sum(a.x * b.x) c FROM x a JOIN x b ON a.r = b.r AND a.v <> b.v GROUP BY ALL")
    c.add("n", "SELECT vi, vj, i, sqrt(sum(c * c)) n FROM p GROUP BY ALL")
    out["combine_pairs"] = c.query(
        "SELECT vi::INTEGER view_idx, i::BIGINT feature_id, round(sum(n), 6) AS value, "
        "round(0.1 * max(max(n)) OVER (PARTITION BY vi), 6) AS bound FROM n GROUP BY vi, i")
    c = embedding_fit(THREE, k=1)
    scores(c)
    pairs = ("SELECT a.q::INTEGER component, a.v::INTEGER view_i, b.v::INTEGER view_j, {m} FROM s a "
             "JOIN s b ON a.r = b.r AND a.q = b.q GROUP BY a.q, a.v, b.v")
    corr = "CASE WHEN a.v = b.v THEN 1 ELSE " + safe("corr(a.s, b.s)") + " END"
    out["canonical_correlations"] = c.query(pairs.format(m=f"round({corr}, 6) + 0.0 AS corr"))
    out["canonical_correlations_frame"] = out["canonical_correlations"]
    out["eval_canonical_corr"] = c.query("SELECT round(avg(corr), 6) AS metric FROM (" + pairs.format(m=f"{corr} AS corr") + ")")
    out["scores"] = c.query("SELECT v::INTEGER view_idx, r::BIGINT row_id, q::INTEGER component, round(s, 6) + 0.0 AS score FROM s")
    out["other_view_score_sum"] = c.query(
        "SELECT v::INTEGER view_idx, r::BIGINT row_id, q::INTEGER component, "
        "round(sum(s) OVER (PARTITION BY r, q) - s, 6) + 0.0 AS score FROM s")
    c = embedding_fit(THREE, k=2)
    out["sigma_pairs"] = c.query(
        "SELECT component::INTEGER component, vi::INTEGER view_i, vj::INTEGER view_j, round(s, 6) + 0.0 AS sigma FROM sig "
        "UNION ALL SELECT q, v, v, 0.0 FROM (VALUES (0), (1)) a(q) CROSS JOIN (VALUES (0), (1), (2)) b(v)")

    # iterations
    c = Ctes()
    for name, q in (e, x, ("pc", cc[1])):
        c.add(name, q)
    c.add("m", "SELECT i, sqrt(sum(c * c)) n FROM pc GROUP BY i ORDER BY 2 DESC, 1 LIMIT 1")
    c.add("x0", "SELECT j, c / n x FROM pc JOIN m USING (i)")
    out["l1_power_init"] = c.query(
        "SELECT j::BIGINT feature_id, round(x, 6) + 0.0 AS value, round(0.1 * n, 6) AS bound FROM x0 CROSS JOIN m")
    c.add("z0", "SELECT i, sign(w) * greatest(0, abs(w) - 0.1 * (SELECT n FROM m)) z FROM (SELECT i, sum(c * x) w FROM pc JOIN x0 USING (j) GROUP BY i)")
    out["power_loss"] = c.query("SELECT round(sum(z * z), 6) AS loss FROM z0")
    c = embedding_fit(TWO)
    out["l1_power_iteration"] = c.query("SELECT f::BIGINT feature_id, round(w, 6) + 0.0 AS value FROM k0t0")
    out["refit_on_support"] = c.query(
        "SELECT v::INTEGER view_idx, f::BIGINT feature_id, round(z, 6) + 0.0 AS value FROM k0fin")
    for name in ("fit_two_view", "fit_two_view_gram", "fit_two_view_sparse", "model_roundtrip"):
        out[name] = c.query(LOADINGS)
    out["fit_three_view"] = embedding_fit(THREE, rhos=(0.1, 0.3, 0.2)).query(LOADINGS)
    for name, parts in (("fit_two_view_converged", TWO), ("fit_three_view_converged", THREE)):
        c = Ctes()
        c.add("e", raw_embeddings(parts))
        centred(c, "e")
        converged(c, len(parts), 0.1)
        out[name] = c.query(LOADINGS)
    out["fit_k2"] = embedding_fit(TWO, k=2).query(LOADINGS)
    out["fit_k3_three_view"] = embedding_fit(THREE, k=3).query(LOADINGS)
    c = Ctes()
    customer_dense(c)
    centred(c, "dense")
    cca(c, 3, 1, (0.1,), 3)
    out["fit_customer_views"] = out["fit_customer_views_sparse"] = c.query(LOADINGS)
    c = Ctes()
    c.add("every", raw_embeddings(TWO))
    c.add("e", "SELECT * FROM every WHERE r % 3 > 0")
    centred(c, "e")
    cca(c, 2, 1, (0.1,), 3)
    out["fit_cells_subset_subjects"] = c.query(LOADINGS)

    # prediction
    c = embedding_fit(TWO, k=2)
    c.add("w", "SELECT v, f, coalesce(sum(z) FILTER (component = 0), 0) z0, coalesce(sum(z) FILTER (component = 1), 0) z1 FROM load GROUP BY v, f")
    c.add("g", "SELECT v, sum(z0 * z0) a, sum(z0 * z1) b, sum(z1 * z1) d FROM w GROUP BY v")
    c.add("pinv", "SELECT v, f, (d * z0 - b * z1) / (a * d - b * b) p0, (a * z1 - b * z0) / (a * d - b * b) p1 FROM w JOIN g USING (v)")
    out["prediction_weights"] = c.query(
        "SELECT v::INTEGER view_idx, q::INTEGER component, f::BIGINT feature_id, round(p, 6) + 0.0 AS weight FROM "
        "(SELECT v, f, 0 q, p0 p FROM pinv UNION ALL SELECT v, f, 1, p1 FROM pinv)")
    scores(c)
    c.add("other", "SELECT 1 - v v, r, coalesce(sum(s) FILTER (q = 0), 0) s0, coalesce(sum(s) FILTER (q = 1), 0) s1 FROM s GROUP BY v, r")
    out["predict_two_components"] = c.query(
        "SELECT x.v::INTEGER view_idx, x.r::BIGINT row_id, x.f::BIGINT feature_id, "
        "round(coalesce(s0 * p0 + s1 * p1, 0), 6) + 0.0 AS prediction FROM x JOIN other o ON o.v = x.v AND o.r = x.r "
        "LEFT JOIN pinv w ON w.v = x.v AND w.f = x.f")
    c = embedding_fit(THREE)
    scores(c)
    predictions(c)
    pred = f"SELECT {CELLS}, round(p, 6) + 0.0 AS prediction FROM pred"
    out["predict_all_views"] = c.query(pred)
    out["predict_view"] = out["transform_outcome"] = c.query(pred + " WHERE v = 1")
    out["transform_frame"] = c.query(
        "SELECT r::BIGINT row_id, f::BIGINT feature_id, round(p, 6) + 0.0 AS prediction FROM pred WHERE v = 0")
    c.add("fc", f"SELECT f, {safe('corr(p, x.x)')} k FROM pred JOIN x USING (v, r, f) WHERE v = 0 GROUP BY f")
    out["eval_prediction"] = c.query("SELECT round(avg(k), 6) AS metric FROM fc")

    # model selection
    out["kfold_assign"] = "SELECT vec_id::BIGINT row_id, (vec_id * 7919 % 5)::INTEGER AS fold FROM embeddings"
    put("holdout_split",
        "SELECT vec_id::BIGINT row_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 400 THEN 'train' ELSE 'test' END AS part FROM embeddings")
    c = Ctes()
    c.add("e", two)
    rows = []
    for g, rho in enumerate((0.1, 0.5)):
        for fold in (0, 1):
            p = f"g{g}f{fold}"
            inside = "r * 7919 % 2 {op} " + str(fold)
            centred(c, f"(SELECT * FROM e WHERE {inside.format(op='<>')})", f"{p}x")
            cca(c, 2, 1, (rho,), 3, x=f"{p}x", p=p)
            centred(c, f"(SELECT * FROM e WHERE {inside.format(op='=')})", f"{p}t")
            scores(c, f"{p}t", f"{p}load", f"{p}s")
            predictions(c, f"{p}t", f"{p}load", f"{p}s", f"{p}pred")
            rows.append(
                f"SELECT {g} g, {fold} fold, avg(k) m FROM (SELECT f, {safe('corr(p, x)')} k FROM {p}pred "
                f"JOIN {p}t USING (v, r, f) WHERE v = 0 GROUP BY f)")
    c.add("m", " UNION ALL ".join(rows))
    c.add("a", "SELECT g, avg(m) m FROM m GROUP BY g")
    out["cv_grid"] = c.query(
        "SELECT g::INTEGER AS grid_point, round(m, 6) AS metric, g = (SELECT g FROM a ORDER BY m DESC, g LIMIT 1) AS best FROM a")
    return out
