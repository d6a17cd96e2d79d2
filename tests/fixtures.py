"""Small variation graphs: id:length nodes, forward links, walks by sample. Bases repeat ACGTACGTAC."""

FIXTURES = {
    "snp": ("1:50 2:20 3:1 4:20 5:50 20:1", "1-2 2-3 3-4 4-5 2-20 20-4", {"ref r1 r2": "1 2 3 4 5", "alt1 alt2 alt3": "1 2 20 4 5"}),
    "small_ins": ("1:50 2:20 3:20 4:50 20:4", "1-2 2-3 3-4 2-20 20-3", {"ref r1 r2": "1 2 3 4", "alt1 alt2": "1 2 20 3 4"}),
    "large_ins": ("1:50 2:20 3:20 4:50 30:60", "1-2 2-3 3-4 2-30 30-3", {"ref r1 r2": "1 2 3 4", "alt1 alt2": "1 2 30 3 4"}),
    "large_del": ("1:50 2:20 3:60 4:20 5:50", "1-2 2-3 3-4 4-5 2-4", {"ref r1 r2": "1 2 3 4 5", "del1 del2": "1 2 4 5"}),
    "small_del": ("1:50 2:20 3:3 4:20 5:50", "1-2 2-3 3-4 4-5 2-4", {"ref r1 r2": "1 2 3 4 5", "del1 del2": "1 2 4 5"}),
    "multiallelic": ("1:50 2:20 3:1 4:20 5:50 20:1 21:1", "1-2 2-3 3-4 4-5 2-20 20-4 2-21 21-4", {"ref r1": "1 2 3 4 5", "a1 a2": "1 2 20 4 5", "b1 b2": "1 2 21 4 5"}),
    "mixed": ("1:50 2:20 3:1 4:20 5:50 20:1 30:60", "1-2 2-3 3-4 4-5 2-20 20-4 4-30 30-5", {"ref r1": "1 2 3 4 5", "snp1 snp2": "1 2 20 4 5", "sv1 sv2": "1 2 3 4 30 5"}),
    "mnp": ("1:50 2:20 3:1 4:1 5:50 20:1 21:1", "1-2 2-3 3-4 4-5 2-20 20-4 3-21 21-5 20-21", {"ref r1": "1 2 3 4 5", "a1 a2": "1 2 20 4 5", "b1 b2": "1 2 3 21 5", "c1 c2": "1 2 20 21 5"}),
    "nested": ("1:50 2:20 3:20 4:50 20:60 21:60 22:60", "1-2 2-3 3-4 2-20 20-21 20-22 21-3 22-3", {"ref r1": "1 2 3 4", "a1 a2": "1 2 20 21 3 4", "b1 b2": "1 2 20 22 3 4"}),
    "cyclic": ("1:50 2:20 3:20 4:50 20:2", "1-2 2-3 3-4 2-20 20-20 20-3", {"ref r1": "1 2 3 4", "a1 a2": "1 2 20 20 3 4"}),
    "long_run": ("1:100 2:100 3:100 4:100 5:100 6:100", "1-2 2-3 3-4 4-5 5-6", {"ref": "1 2 3 4 5 6"}),
}

#: Counters at a limit of 50: ST NR SN BR SA SB LB LA UM TW NW NS WR TS.
GOLDENS = {
    "snp": (1, 1, 1, 1, 1, 6, 6, 0, 4, 6, 5, 6, 6, 141), "small_ins": (1, 1, 0, 4, 1, 5, 5, 0, 3, 5, 4, 5, 5, 140), "large_ins": (0, 0, 0, 0, 3, 5, 5, 3, 2, 5, 4, 5, 5, 200),
    "large_del": (0, 0, 0, 0, 3, 5, 5, 3, 2, 5, 4, 5, 5, 200), "small_del": (1, 0, 0, 0, 1, 5, 5, 0, 4, 5, 4, 5, 5, 143), "multiallelic": (1, 2, 2, 2, 1, 7, 8, 0, 4, 6, 5, 6, 6, 141),
    "mixed": (1, 1, 1, 1, 3, 7, 8, 3, 3, 6, 5, 6, 6, 201), "mnp": (1, 2, 2, 2, 1, 7, 9, 0, 4, 8, 7, 8, 8, 122), "nested": (0, 0, 0, 0, 5, 7, 8, 6, 2, 6, 5, 6, 6, 320),
    "cyclic": (0, 0, 0, 0, 3, 5, 6, 4, 2, 4, 3, 4, 4, 142), "long_run": (0, 0, 0, 0, 1, 6, 5, 0, 5, 1, 0, 1, 1, 600),
}
GOLDEN_TAGS = "ST NR SN BR SA SB LB LA UM TW NW NS WR TS".split()


def bases(n: int) -> str:
    return ("ACGTACGTAC" * (n // 10 + 1))[:n]


def gfa(nodes: str, links: str, walks: dict[str, str]) -> str:
    size = dict(x.split(":") for x in nodes.split())
    out = ["H\tVN:Z:1.1\tRS:Z:ref"]
    out += [f"S\t{i}\t{bases(int(n))}" for i, n in size.items()]
    out += ["L\t{}\t+\t{}\t+\t0M".format(*x.split("-")) for x in links.split()]
    for samples, path in walks.items():
        span = sum(int(size[i]) for i in path.split())
        out += [f"W\t{s}\t0\tchr1\t0\t{span}\t>" + ">".join(path.split()) for s in samples.split()]
    return "\n".join(out) + "\n"


def texts() -> dict[str, str]:
    return {k: gfa(*v) for k, v in FIXTURES.items()}
