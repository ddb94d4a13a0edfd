"""Plain sequential models of the operators, for small inputs only."""

import numpy as np


def scores(vecs):
    vecs = np.asarray(vecs, dtype=np.float32).astype(float)
    return np.round(vecs @ vecs.T, 6)


def neighbour_lists(vecs, neighbours, floor=None):
    """Row → its best `neighbours` - 1 other rows, by score and then row."""
    s = scores(vecs)
    lists = {}
    for i in range(len(s)):
        others = sorted((j for j in range(len(s)) if j != i), key=lambda j: (-s[i, j], j))[: neighbours - 1]
        lists[i] = [j for j in others if floor is None or s[i, j] >= floor]
    return lists


def number(labels):
    """Cluster labels as 0, 1, 2 … in the order of their first row."""
    seen = {}
    return [seen.setdefault(label, len(seen)) for label in labels]


def components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def mutual_knn(vecs, threshold, neighbours):
    lists = neighbour_lists(vecs, neighbours)
    s = scores(vecs)
    edges = [(i, j) for i in lists for j in lists[i] if i < j and i in lists[j] and s[i, j] >= threshold]
    return edges, number(components(len(vecs), edges))


def leader(vecs, threshold):
    s, leaders, labels = scores(vecs), [], []
    for i in range(len(s)):
        best = max(leaders, key=lambda j: (s[i, j], -j), default=None)
        if best is None or s[i, best] < threshold:
            leaders.append(i)
            best = i
        labels.append(best)
    return number(labels)


def average_linkage(vecs, threshold):
    vecs = np.asarray(vecs, dtype=np.float32).astype(float)
    pairwise = vecs @ vecs.T
    clusters = {i: [i] for i in range(len(vecs))}
    while len(clusters) > 1:
        best = None
        ids = sorted(clusters)
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                mean = round(float(pairwise[np.ix_(clusters[a], clusters[b])].mean()), 6)
                if best is None or mean > best[0]:
                    best = (mean, a, b)
        if best[0] <= threshold:
            break
        clusters[best[1]] += clusters.pop(best[2])
    label = {row: name for name, rows in clusters.items() for row in rows}
    return number([label[i] for i in range(len(vecs))])


def tag_spans(tokens):
    """Entities (start, end, type) of tokens (label, start, end)."""
    spans, open_ = [], None
    for label, start, end in tokens + [("O", 0, 0)]:
        kind = label.rsplit("-", 1)[-1]
        if label == "O" or start == end:
            if open_:
                spans.append(tuple(open_))
            open_ = None
        elif open_ and (kind == open_[2] or label.startswith("I-")):
            open_[1] = end
        else:
            if open_:
                spans.append(tuple(open_))
            open_ = [start, end, kind]
    return spans
