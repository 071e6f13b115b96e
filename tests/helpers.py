"""Trace builders and a sequential walk that states the expected results."""

from collections import defaultdict

READ, WRITE = 1, 0
SCHEMA = "rec_idx long, rw long, paddr long"


def access(s, g):
    """Address in L1 set ``s`` with a distinct tag per ``g``."""
    return g * 131072 + s * 64


def burst(t0, s=5, tags=range(1, 9), rw=READ, step=1):
    return [(t0 + i * step, rw, access(s, g)) for i, g in enumerate(tags)]


def table(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(partitions) if partitions else df


def triples(df):
    """Sorted (set, lines, centre)."""
    return sorted((r.set_idx, r.n_lines, r.center) for r in df.collect())


def keyed(df):
    return sorted((r.rw, r.set_idx, r.n_lines, r.center) for r in df.collect())


def walk(rows, p, kinds, all_chains=False):
    """(bursts, detections) of a trace, one access after the other."""
    sets = defaultdict(list)
    for idx, rw, paddr in sorted(rows):
        if p.has_kinds and rw not in kinds:
            continue
        u = paddr % 2**64
        key = (rw if p.has_kinds else -1, (u >> p.line_bits) & p.set_mask)
        sets[key].append((idx, u >> p.tag_shift))
    bursts, found = [], []
    for key, accesses in sets.items():
        groups = [[accesses[0]]]
        for prev, cur in zip(accesses, accesses[1:]):
            if cur[0] - prev[0] < p.intra:
                groups[-1].append(cur)
            else:
                groups.append([cur])
        stats = []
        for g in groups:
            times = [t for t, _ in g]
            lines = len({tag for _, tag in g}) if len(g) > 1 else 0
            stats.append((lines, sum(times) // len(g), len(g), times[0], times[-1]))
        bursts += [key + s for s in stats]
        good = [s[:2] for s in stats if s[0] >= p.assoc]
        if p.inter is None:
            chains = [good]
        else:
            chains = []
            for b in good:
                if chains and b[1] - chains[-1][-1][1] <= p.inter:
                    chains[-1].append(b)
                else:
                    chains.append([b])
            if not all_chains:
                chains = chains[:1]
        kept = [b for c in chains if len(c) > 1 for b in c]
        found += [key + b for b in kept]
    return sorted(bursts), sorted(found)
