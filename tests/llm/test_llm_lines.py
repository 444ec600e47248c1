from collections import defaultdict

from pyspark.sql import functions as F
from vetline.llm import lines

from awkward_rows import ROWS, clashing, rows_of


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, _, source, _ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line].add(source or "")
                place = (doc is not None, doc or 0, pos)
                first[line] = min(first.get(line, place), place)
    out = []
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        kept = [
            p for i, p in enumerate(parts)
            if not p.strip(" ") or len(sites[p]) < min_sites or first[p] == (doc is not None, doc or 0, i)
        ]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def marked(docs, n):
    return rows_of(lines.mark_lines(docs, n).select("doc_id", "n_lines", "n_removed", "kept_text"))


def test_odd_rows(odd, none):
    for n in (1, 2, 3):
        assert marked(odd, n) == brute(ROWS, n)
    assert marked(clashing(odd), 2) == brute(ROWS, 2)
    assert lines.mark_lines(none).count() == 0


def test_spread_near_threshold(frame):
    """Exact counts decide around the threshold, whatever the sketch estimates."""
    rows = []
    for sites in (1, 9, 10, 11, 60, 400):
        rows += [(1000 * sites + i, f"only {sites} {i}\nshared {sites}\n", "en", f"s{i}", 1) for i in range(sites)]
    assert marked(frame(rows), 10) == brute(rows, 10)
    assert marked(frame(rows), 50) == brute(rows, 50)


def test_one_line_in_most_documents(frame):
    rows = [(i, f"head\nbody {i}\nhead\n\nfoot", "en", f"s{i % 12}", 1) for i in range(600)]
    assert marked(frame(rows), 10) == brute(rows, 10)


def test_stage_keeps_columns(odd):
    docs = clashing(odd)
    out = lines.drop_lines(docs, 2)
    assert out.dtypes == docs.dtypes
    kept = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert (3, None, None) in kept and (6, "word", 4) in kept
    changed = [(d, t) for d, _, n, t in brute(ROWS, 2) if n]
    assert all((d, t, len(t)) in kept for d, t in changed)


def test_native(odd):
    plan = lines.mark_lines(odd, 2).select(F.sha2("kept_text", 256))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
