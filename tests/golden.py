"""The metrics once more in plain numpy, from their definitions, to test the engine against."""

import numpy as np


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    i = 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[order[j + 1]] == x[order[i]]:
            j += 1
        out[order[i : j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return out


def pearson(a, b):
    return np.corrcoef(a, b)[0, 1]


def nse(o, s):
    return 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum()


def classical(o, s):
    e, mo, ms, so, ss, n = s - o, o.mean(), s.mean(), o.std(), s.std(), len(o)
    r, rs = pearson(o, s), pearson(ranks(o), ranks(s))
    od, sd = np.sort(o)[::-1], np.sort(s)[::-1]
    eps = 0.01 * mo
    k, start = max(1, int(np.floor(0.02 * n + 0.5))), int(np.floor(0.7 * n))
    lo, ls = np.log(od[start:] + eps), np.log(sd[start:] + eps)
    b = ((o - mo) * (s - ms)).sum() / ((o - mo) ** 2).sum()
    q = lambda x, p: np.log(np.quantile(x, 1 - p) + eps)
    kge = lambda *x: 1 - np.sqrt(sum(v * v for v in x))
    dev, reach, mae = np.abs(o - mo), np.abs(s - mo) + np.abs(o - mo), np.abs(e).mean()
    ratio = np.log(s / o)
    sae = np.abs(e).sum()
    return {
        "me": e.mean(), "mae": mae, "mdae": np.median(np.abs(e)), "mse": (e * e).mean(), "rmse": np.sqrt((e * e).mean()), "rsr": np.sqrt((e * e).mean()) / so, "nrmse_mean": np.sqrt((e * e).mean()) / mo, "nrmse_range": np.sqrt((e * e).mean()) / np.ptp(o),
        "nrmse_iqr": np.sqrt((e * e).mean()) / np.subtract(*np.quantile(o, [0.75, 0.25])), "mape": 100 * np.abs(e / o).mean(), "smape": 100 * (np.abs(e) / ((np.abs(o) + np.abs(s)) / 2)).mean(), "maape": np.arctan(np.abs(e / o)).mean(), "mapd": 100 * sae / np.abs(o).sum(),
        "msle": (ratio**2).mean(), "mle": ratio.mean(), "male": np.abs(ratio).mean(), "rmsle": np.sqrt((ratio**2).mean()), "mde": np.median(e), "mdse": np.median(e * e), "mase": mae / np.abs(np.diff(o)).mean(),
        "r": r, "r2": r * r, "wr2": abs(b) * r * r if abs(b) <= 1 else r * r / abs(b), "spearman": rs, "d": 1 - (e * e).sum() / (reach**2).sum(), "d1": 1 - sae / reach.sum(), "dr": 1 - sae / (2 * dev.sum()) if sae <= 2 * dev.sum() else 2 * dev.sum() / sae - 1,
        "drel": 1 - ((e / o) ** 2).sum() / ((reach / mo) ** 2).sum(), "lm_index": 1 - sae / dev.sum(), "nse": nse(o, s), "nse_mod": 1 - sae / dev.sum(), "nse_rel": 1 - ((e / o) ** 2).sum() / (((o - mo) / mo) ** 2).sum(), "lognse": nse(np.log(o + eps), np.log(s + eps)),
        "kge2009": kge(r - 1, ss / so - 1, ms / mo - 1), "kge2012": kge(r - 1, (ss / ms) / (so / mo) - 1, ms / mo - 1), "kge2021": kge(r - 1, ss / so - 1, (ms - mo) / so), "kgenp": kge(rs - 1, 0.5 * np.abs(np.sort(s / (n * ms)) - np.sort(o / (n * mo))).sum(), ms / mo - 1),
        "ve": 1 - sae / o.sum(), "pbias": 100 * (o - s).sum() / o.sum(), "beta_nse": (ms - mo) / so, "alpha": ss / so, "fhv": 100 * (sd[:k] - od[:k]).sum() / od[:k].sum(), "flv": -100 * ((ls - ls.min()).sum() - (lo - lo.min()).sum()) / (lo - lo.min()).sum(),
        "fms": 100 * ((q(s, 0.2) - q(s, 0.7)) - (q(o, 0.2) - q(o, 0.7))) / (q(o, 0.2) - q(o, 0.7)), "fmm": 100 * (np.log(np.median(s) + eps) - np.log(np.median(o) + eps)) / np.log(np.median(o) + eps),
    }


def dtw(a, b, fraction):
    n, m = len(a), len(b)
    band = max(1, int(np.ceil(fraction * max(n, m))), abs(n - m))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[n, m]


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ (a >> 15)) * (a | 1) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield (t ^ (t >> 14)) / 4294967296
