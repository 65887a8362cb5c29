"""Line dedup against plain Python."""

from agoralytics.llm import line_winnow


def plain(rows, lines=3, characters=300, words=40):
    """Every window against the first equal one, extended line by line."""
    first, out = {}, {}
    solid_of = {i: [(k, s.strip(" ")) for k, s in enumerate((text or "").split("\n")) if s.strip(" ")] for i, text in rows}
    for i, text in rows:
        cut, solid = (text or "").split("\n"), solid_of[i]
        gone = set()
        for a in range(len(solid)):
            size = next((k for k in range(1, lines) if sum(len(s) for _, s in solid[a : a + k]) >= characters or sum(s.count(" ") + 1 for _, s in solid[a : a + k]) >= words), lines)
            if a + size > len(solid):
                continue
            key = tuple(s for _, s in solid[a : a + size])
            if key not in first:
                first[key] = (i, a)
                continue
            j, b = first[key]
            other, low, high = solid_of[j], 0, size
            while a + low > 0 and b + low > 0 and low > 1 - lines and solid[a + low - 1][1] == other[b + low - 1][1]:
                low -= 1
            while a + high < len(solid) and b + high < len(other) and high < size + lines - 1 and solid[a + high][1] == other[b + high][1]:
                high += 1
            gone |= set(range(solid[a + low][0], solid[a + high - 1][0] + 1))
        out[i] = (len(cut), len(gone), "\n".join(s for k, s in enumerate(cut) if k not in gone))
    return out


def result(frame):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in frame.collect()}


def test_random(spark, rng):
    rows = [(i, "\n".join(rng.choice(["a", "b", "c ", "", " ", "d" * 320, "e" * 160, "f g " * 11]) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    assert result(line_winnow.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_on_table(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert result(line_winnow.drop_repeats(documents)) == plain(rows)


def test_odd(odd, none):
    rows = line_winnow.drop_repeats(odd).collect()
    assert len(rows) == odd.count() and {(r.n_lines, r.n_removed, r.text) for r in rows if r.doc_id in (1, 2)} == {(1, 0, "")}
    assert line_winnow.drop_repeats(none).count() == 0
    # of equal long lines the first in the order of ids stays, the row without an id is last
    long = "x" * 400
    frame = odd.sparkSession.createDataFrame([(None, long), (2, long), (1, long), (1, long)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed, r.n_runs) for r in line_winnow.drop_repeats(frame).collect()) == [("1", 0, 0), ("1", 0, 0), ("2", 1, 1), ("None", 1, 1)]


def test_one_line_passage(spark):
    """A line of 43 words in unrelated documents stays in the first only, and so does what stands beside it in both."""
    passage = " ".join(f"w{k}" for k in range(43))
    rows = [(i, f"own {i}\nby the desk\n{passage}\n\nread more\nend {i}") for i in range(6)] + [(9, f"alone\n{passage}")]
    got = result(line_winnow.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows)
    assert got[0][1] == 0 and got[9] == (2, 1, "alone") and all(got[i] == (6, 4, f"own {i}\nend {i}") for i in range(1, 6))
