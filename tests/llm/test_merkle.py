import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import merkle as M


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return sha256("".join(map(field, (row[0], row[3], row[2], row[4], text))).encode()).hexdigest()


def up(level, at):
    """root of a level, and the siblings of its node ``at`` on the way"""
    proof = []
    while len(level) > 1:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        proof.append((run[:at % 16], run[at % 16 + 1:]))
        level = [sha256("".join(level[i:i + 16]).encode()).hexdigest() for i in range(0, len(level), 16)]
        at //= 16
    return level[0], proof


def brute(rows):
    """rows (doc_id, text, lang, source, n_chars, ...) -> sorted result rows"""
    groups = {}
    for r in rows:
        groups.setdefault("n" if r[3] is None else "s" + r[3], []).append(r)
    keys = sorted(groups, key=lambda k: k.encode())
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    levels = {k: [leaf_of(r, r[1]) for r in groups[k]] for k in keys}
    subroots = [up(levels[k], 0)[0] for k in keys]
    out = []
    for g, k in enumerate(keys):
        root, above = up(subroots, g)
        for i, r in enumerate(groups[k]):
            subroot, proof = up(levels[k], i)
            proof = proof + above
            node = levels[k][i]
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in proof:
                node = sha256("".join([*a, node, *b]).encode()).hexdigest()
            digest = sha256("".join(x for a, b in proof for x in [*a, *b]).encode()).hexdigest()
            out.append((r[0], levels[k][i], subroot, root, digest, node, node == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in M.verify_documents(df).collect()), key=str)


def test_awkward_rows(spark):
    assert result(awkward(spark)) == brute(awkward_rows())


def test_empty_table_and_a_single_row(spark):
    assert result(empty(spark)) == []
    row = awkward_rows()[6]
    got = result(awkward(spark).where("doc_id = 7"))
    assert got == brute([row]) and got[0][1] == got[0][2] == got[0][3]
    assert got[0][4] == sha256(b"").hexdigest()


def test_trees_of_several_blocks_and_many_groups(spark):
    rows = [(i, f"Text {i}", "en", "hot" if i % 5 else f"site {i % 200}", i % 7) for i in range(11_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = result(df)
    assert got == brute(rows)
    changed = [r for r in got if not r[6]]
    assert {r[0] for r in changed} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_every_node_has_a_place_of_its_own_and_subtrees_are_contiguous(levels):
    places = [M.address(d, np.arange(16 ** d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(M.subtree_size(levels)))
    if levels > 1:  # the bottom subtrees of the first split lie one after the other, each in one piece
        top, below = levels // 2, levels - levels // 2
        for s in {0, 1, 16 ** top - 1}:
            own = np.concatenate([places[top + d][s * 16 ** d:(s + 1) * 16 ** d] for d in range(below)])
            start = M.subtree_size(top) + s * M.subtree_size(below)
            assert sorted(own.tolist()) == list(range(start, start + M.subtree_size(below)))


def test_folding_the_siblings_of_any_leaf_gives_the_root():
    digests = np.frombuffer(b"".join(sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    levels = M.levels_for(3000)
    nodes = M.build_block(digests, levels)
    texts = M.level_texts(nodes.tobytes(), 3000, levels)
    for i in (0, 15, 16, 2999, 1234):
        assert M.fold(digests[i].tobytes().hex(), *M.siblings(texts, i)) == nodes[0].tobytes().hex()
