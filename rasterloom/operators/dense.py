"""What happens inside one tile: erosion by runs and exact nearest sources, on numpy arrays.

Every function is linear in the tile's cells, whatever the reach.
"""

from __future__ import annotations

import numpy as np

FAR = np.int64(1) << 40


def run_bounds(codes: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, along ``axis``, of the run of equal codes that each cell lies in."""
    codes = np.moveaxis(codes, axis, 1)
    n = codes.shape[1]
    place = np.arange(n)[None, :]
    changes = np.ones(codes.shape, bool)
    changes[:, 1:] = codes[:, 1:] != codes[:, :-1]
    first = np.maximum.accumulate(np.where(changes, place, 0), axis=1)
    ends = np.ones(codes.shape, bool)
    ends[:, :-1] = changes[:, 1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[:, ::-1], axis=1)[:, ::-1]
    return np.moveaxis(first, 1, axis), np.moveaxis(last, 1, axis)


def interior(codes: np.ndarray, reach: int) -> np.ndarray:
    """Cells whose whole square of ``reach`` has their code; -1 is no code, outside counts as none.

    Along x a run loses ``reach`` cells at either end; along y the same holds for the
    runs of what is left.
    """
    kept = codes
    for axis in (1, 0):
        first, last = run_bounds(kept, axis)
        place = np.arange(codes.shape[axis]).reshape((1, -1) if axis else (-1, 1))
        kept = np.where((place - first >= reach) & (last - place >= reach), kept, -1)
    return kept >= 0


def paint(
    y: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray, window: tuple[int, int, int, int]
) -> np.ndarray:
    """Runs as an array over ``window`` (top, left, height, width); cells without a run are -1."""
    top, left, height, width = window
    out = np.full(height * width, -1, np.int64)
    first, last = np.maximum(first, left), np.minimum(last, left + width - 1)
    inside = (y >= top) & (y < top + height) & (first <= last)
    y, first, last, value = y[inside], first[inside], last[inside], value[inside]
    lengths = last - first + 1
    begin = (y - top) * width + first - left
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin, lengths) + step] = np.repeat(value, lengths)
    return out.reshape(height, width)


def _nearest_in_line(source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to, and column of, the nearest source of the same line; the left one on a tie."""
    place = np.arange(source.shape[1])[None, :]
    left = np.maximum.accumulate(np.where(source, place, -FAR), axis=1)
    right = np.minimum.accumulate(np.where(source, place, FAR)[:, ::-1], axis=1)[:, ::-1]
    use_left = place - left <= right - place
    return np.where(use_left, place - left, right - place), np.where(use_left, left, right)


def nearest_source(source: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, column, squared distance) of every cell's nearest source; FAR (and line and column 0) where none is within ``radius``.

    Exact distance transform: nearest sources along the lines, then per column the
    lower envelope of the parabolas (y - line)^2 + distance^2. All columns
    advance together. Ties go to the uppermost line, then to the left source: a
    later parabola takes over at the first whole y where it is strictly lower.
    """
    height, width = source.shape
    away, column = _nearest_in_line(source)
    away = np.where(away <= radius, away * away, FAR)
    column_at = np.arange(width)
    lines = np.zeros((height, width), np.int64)  # lines on the envelope, a stack per column
    starts = np.zeros((height + 1, width), np.int64)  # where each takes over
    depth = np.zeros(width, np.int64)
    for line in range(height):
        todo = column_at[away[line] < FAR]
        while len(todo):
            empty = depth[todo] == 0
            top = lines[np.maximum(depth[todo] - 1, 0), todo]
            rise = away[line, todo] + line * line - away[top, todo] - top * top
            start = np.where(empty, 0, rise // np.maximum(2 * (line - top), 1) + 1)
            hidden = ~empty & (start <= starts[np.maximum(depth[todo] - 1, 0), todo])
            depth[todo[hidden]] -= 1
            put, at = todo[~hidden], np.maximum(start[~hidden], 0)
            lines[depth[put], put] = line
            starts[depth[put], put] = at
            depth[put] += 1
            todo = todo[hidden]
    chosen = np.zeros(width, np.int64)
    out_line, out_away = np.zeros((height, width), np.int64), np.full((height, width), FAR)
    some = depth > 0
    for line in range(height):
        while True:
            more = (chosen + 1 < depth) & (starts[np.minimum(chosen + 1, height), column_at] <= line)
            if not more.any():
                break
            chosen[more] += 1
        best = lines[chosen, column_at]
        out_line[line] = best
        out_away[line] = np.where(some, (line - best) ** 2 + away[best, column_at], FAR)
    out_away[out_away > radius * radius] = FAR
    found = out_away < FAR
    return np.where(found, out_line, 0), np.where(found, column[out_line, column_at[None, :]], 0), out_away
