import numpy as np
import pandas as pd


def emb_frame(spark, x, **keys):
    """(keys..., w, vec) from a (W, D) matrix."""
    pdf = pd.DataFrame({**{k: [v] * len(x) for k, v in keys.items()},
                        "w": np.arange(len(x)), "vec": [list(map(float, r)) for r in x]})
    return spark.createDataFrame(pdf)


def edge_frame(spark, nn, **keys):
    """(keys..., i, j) from a (W, k) neighbour array."""
    w, k = nn.shape
    pdf = pd.DataFrame({**{c: [v] * (w * k) for c, v in keys.items()},
                        "i": np.repeat(np.arange(w), k), "j": nn.ravel().astype(np.int64)})
    return spark.createDataFrame(pdf)


def brute_knn(x, k, excl=0, metric="cosine"):
    """Neighbours by full sort; ties to the smaller index."""
    x = np.asarray(x, float)
    if metric == "cosine":
        z = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        score = np.round(z @ z.T, 12)
    else:
        score = -np.round(np.sqrt(np.square(x[:, None] - x[None]).sum(-1)), 12)
    n = len(x)
    i = np.arange(n)
    score[np.abs(i[:, None] - i[None]) <= excl] = -np.inf
    out = []
    for r in range(n):
        order = np.lexsort((i, -score[r]))
        out.append([c for c in order if np.isfinite(score[r, c])][:k])
    return out


def literal_mknn(nn_a, nn_b, d):
    """Recount of one rotation, one window at a time."""
    w, k = nn_a.shape
    hits = 0
    for i in range(w):
        moved = {(int(j) + d) % w for j in nn_b[(i - d) % w]}
        hits += sum(int(a) in moved for a in nn_a[i])
    return hits / (w * k)


def random_graph(rng, w, k):
    return np.stack([rng.choice(w - 1, k, replace=False) for _ in range(w)])
