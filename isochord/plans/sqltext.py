"""Building blocks of the SQL each query is checked against."""

from __future__ import annotations

from isochord.plans.bindings import (EIGHTHS, HALVES, K, LAYERED, MODELS, PLAIN,  # noqa: F401
                                     SUBJECTS, WHOLE)

E = ("e AS (SELECT vec_id::BIGINT AS w, label, embedding::DOUBLE[] AS v FROM embeddings), "
     "nw AS (SELECT count(*)::BIGINT AS n FROM embeddings)")


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0"


def spaces(slots=PLAIN) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS side, {layer} AS layer, '{subj}' AS subject, w, "
        f"v[{first}:{first + size - 1}] AS v FROM e"
        for s, layer, subj, first, size in slots)
    return f"{E}, sp AS ({rows})"


def model_spaces() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS side, 0 AS layer, 's0' AS subject, w, "
        f"v[{first}:{first + size - 1}] AS v FROM e"
        for m, _, _, first, size in MODELS)
    dim = ", ".join(f"('{m}', '{f}', {r})" for m, f, r, _, _ in MODELS)
    return f"{E}, sp AS ({rows}), dim(model, family, size_rank) AS (VALUES {dim})"


def knn(k: int = K, excl: int = 0) -> str:
    """Edge table nn(side, layer, subject, i, j, sim, rank)."""
    return (f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, layer, "
            f"subject, i ORDER BY sim DESC, j) AS rank FROM (SELECT x.side, x.layer, "
            f"x.subject, x.w AS i, y.w AS j, "
            f"round(list_cosine_similarity(x.v, y.v), 12) AS sim "
            f"FROM sp x JOIN sp y ON x.side = y.side AND x.layer = y.layer "
            f"AND x.subject = y.subject AND abs(x.w - y.w) > {excl})) WHERE rank <= {k})")


def euclid(k: int) -> str:
    """Edge table dd(side, layer, subject, i, j, dist, rank) by Euclidean distance."""
    return (f"dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, layer, "
            f"subject, i ORDER BY dist, j) AS rank FROM (SELECT x.side, x.layer, "
            f"x.subject, x.w AS i, y.w AS j, round(list_distance(x.v, y.v), 12) AS dist "
            f"FROM sp x JOIN sp y ON x.side = y.side AND x.layer = y.layer "
            f"AND x.subject = y.subject AND x.w <> y.w)) WHERE rank <= {k})")


def curve(k: int = K) -> str:
    """Scores at all rotations per layer pair and subject: cv(subject, la, lb, d, score)."""
    return (f"edge AS (SELECT *, ((i - j) % n + n) % n AS u FROM nn, nw), "
            f"hit AS (SELECT a.subject, a.layer AS la, b.layer AS lb, "
            f"((a.i - b.i) % a.n + a.n) % a.n AS d, count(*) AS c FROM edge a JOIN edge b "
            f"ON a.u = b.u AND a.subject = b.subject AND a.side = 'a' AND b.side = 'b' "
            f"GROUP BY ALL), "
            f"pr AS (SELECT DISTINCT a.subject, a.layer AS la, b.layer AS lb "
            f"FROM (SELECT DISTINCT side, layer, subject FROM sp) a "
            f"JOIN (SELECT DISTINCT side, layer, subject FROM sp) b "
            f"ON a.subject = b.subject AND a.side = 'a' AND b.side = 'b'), "
            f"cv AS (SELECT p.subject, p.la, p.lb, g.d, "
            f"coalesce(h.c, 0) / (nw.n * {k})::DOUBLE AS score FROM pr p, nw, "
            f"(SELECT unnest(range(n)) AS d FROM nw) g LEFT JOIN hit h "
            f"ON h.subject = p.subject AND h.la = p.la AND h.lb = p.lb AND h.d = g.d)")


def model_curve(k: int = K) -> str:
    """Scores at all rotations per unordered model pair: cv(a, b, fa, fb, ra, rb, d, score)."""
    return (f"edge AS (SELECT *, ((i - j) % n + n) % n AS u FROM nn, nw), "
            f"hit AS (SELECT a.side AS a, b.side AS b, "
            f"((a.i - b.i) % a.n + a.n) % a.n AS d, count(*) AS c FROM edge a JOIN edge b "
            f"ON a.u = b.u AND a.side < b.side GROUP BY ALL), "
            f"pr AS (SELECT x.model AS a, y.model AS b, x.family AS fa, y.family AS fb, "
            f"x.size_rank AS ra, y.size_rank AS rb FROM dim x JOIN dim y "
            f"ON x.model < y.model), "
            f"cv AS (SELECT p.*, g.d, coalesce(h.c, 0) / (nw.n * {k})::DOUBLE AS score "
            f"FROM pr p, nw, (SELECT unnest(range(n)) AS d FROM nw) g "
            f"LEFT JOIN hit h ON h.a = p.a AND h.b = p.b AND h.d = g.d)")


def cyclic(src: str, keys: str, alpha_num: int = 95) -> str:
    """cal(keys, obs, tau, s_cal, p, null_mean, excess) from a table of d, score."""
    return (f"ordd AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score) "
            f"AS rn, count(*) OVER (PARTITION BY {keys}) AS n, "
            f"max(CASE WHEN d = 0 THEN score END) OVER (PARTITION BY {keys}) AS obs "
            f"FROM {src}), "
            f"cal0 AS (SELECT {keys}, max(obs) AS obs, "
            f"max(CASE WHEN rn = (n * {alpha_num} + 99) // 100 THEN score END) AS tau, "
            f"(1 + count(*) FILTER (d <> 0 AND score >= obs)) / count(*)::DOUBLE AS p, "
            f"avg(score) FILTER (d <> 0) AS null_mean FROM ordd GROUP BY {keys}), "
            f"cal AS (SELECT *, CASE WHEN tau < 1 THEN greatest((obs - tau) / (1 - tau), 0.0) "
            f"ELSE 0.0 END AS s_cal, obs - null_mean AS excess FROM cal0)")


def signed(d: str = "d") -> str:
    return f"(CASE WHEN {d} <= n // 2 THEN {d} ELSE {d} - n END)"
