def brute_components(rows, threshold=4):
    """doc_id to component over pairs (doc_id, fingerprint), by comparing every pair."""
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(rows)
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if (x ^ y).bit_count() <= threshold:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {x: top(x) for x in parent}
