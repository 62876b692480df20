"""Plain Python models the Spark results are compared with."""

import heapq
from collections import defaultdict
from math import inf


def shortest(arcs):
    """{(source, target): cost} over (source, target, cost) arcs; no pair returns to its start."""
    out = defaultdict(list)
    for source, target, cost in arcs:
        if cost is not None and cost < inf:
            out[source].append((target, cost))
    result = {}
    for origin in list(out):
        best, queue = {}, [(0.0, origin)]
        while queue:
            cost, node = heapq.heappop(queue)
            if node in best:
                continue
            best[node] = cost
            for target, step in out.get(node, ()):
                if target not in best:
                    heapq.heappush(queue, (cost + step, target))
        for node, cost in best.items():
            if node != origin:
                result[origin, node] = cost
    return result
