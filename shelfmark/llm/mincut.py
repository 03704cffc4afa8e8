"""Minimum cut between source and sink on small graphs, by augmenting along breadth-first levels."""

from __future__ import annotations

from collections import deque


def source_side(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source in a minimum cut.

    Node i costs to_sink[i] when it stays with the source and to_source[i] when it goes to the sink; an undirected edge costs its
    weight when its ends part.  Nodes that cost the same on either side go to the sink.
    """
    n = len(to_source)
    left, right = list(to_source), list(to_sink)
    for i in range(n):  # the part that flows straight through a node
        straight = min(left[i], right[i])
        left[i] -= straight
        right[i] -= straight
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, weight in edges:
        if a != b and weight > 0:
            near[a][b] = near[a].get(b, 0.0) + weight
            near[b][a] = near[b].get(a, 0.0) + weight
    while True:
        came = {i: -1 for i in range(n) if left[i] > 1e-12}
        queue, end = deque(came), -1
        while queue:
            i = queue.popleft()
            if right[i] > 1e-12:
                end = i
                break
            for j, room in near[i].items():
                if room > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(n)]
        path, i = [end], end
        while came[i] >= 0:
            i = came[i]
            path.append(i)
        flow = min([left[i], right[end], *(near[b][a] for a, b in zip(path, path[1:]))])
        left[i] -= flow
        right[end] -= flow
        for a, b in zip(path, path[1:]):
            near[b][a] -= flow
            near[a][b] += flow
