"""Plain loops that say what each rule means, row by row."""

from __future__ import annotations

import math


def offsets(packets):
    at, out = 0, []
    for p in packets:
        out.append(at)
        at += max(p["size"], 0)
    return out


def complete(packets, start, bound):
    at, flags, broken = start, [], False
    for p in packets:
        if broken or p["size"] <= 0:
            flags.append(False)
            continue
        if at + p["size"] > bound:
            broken = True
            flags.append(False)
            continue
        at += p["size"]
        flags.append(True)
    return flags


def resume_point(packets, open_gop, den):
    video = [p for p in packets if p["is_video"]]
    back = lambda f: f - 17 if open_gop and f > 17 else f

    def top(frame):
        return max([p["dts"] for p in video if 0 <= p["frame_no"] < frame], default=-1)

    keys = [p["frame_no"] for p in video if p["is_key"] and p["frame_no"] >= 0]
    if not video:
        return 0
    for key in reversed(keys):
        cand = back(key)
        if cand == 0:
            break
        if top(cand) < (cand - 2) * den:
            return cand
    for frame in range(back(keys[-1]) if keys else 0, 0, -1):
        if top(frame) < (frame - 2) * den:
            return frame
    return 0


def monotone(video):
    last, out = None, []
    for p in video:
        dts, pts = max(p["dts"], 0), p["pts"]
        if last is not None and dts <= last:
            dts = last + 1
            pts = max(pts, dts)
        last = dts
        out.append((pts, dts))
    return out


def frame_duration(times):
    best = best_n = current = n = 0
    times = sorted(t for t in times if t > 0)
    for a, b in zip(times, times[1:]):
        gap = b - a
        if gap <= 0:
            continue
        current, n = (current, n + 1) if gap == current else (gap, 1)
        if n > best_n:
            best, best_n = current, n
    return best or 1


def align(first, rate, num, den):
    frame = 0
    while (frame + 1) * rate * den // num <= first:
        frame += 1
    return frame


def dedup(numbers):
    due, out = 0, []
    for n in numbers:
        if n >= due:
            out.append(n)
            due = n + 1
    return out


def released(numbers, start):
    have, out = set(numbers), []
    while start in have:
        out.append(start)
        start += 1
    return out


def psnr(a, b, peak):
    error = sum((x - y) ** 2 for x, y in zip(a, b)) / len(a)
    return 99.0 if error <= 0 else 10 * math.log10(peak * peak / error)
