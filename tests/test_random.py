"""Random searches and random ingest rules against their plain meaning."""

import random
import re

from conftest import paths
from pyspark.sql import functions as F
from test_search import slow_glob

from pathlode import AnyOf, Excludes, Glob, Not, Regex, Substring, build_catalogue
from pathlode.operators.predicates import criteria
from pathlode.schema import ENTRY

WORD = re.compile(r"\w+")


def slow_term(term, text, match_case, whole_word, whole_filename):
    options = (match_case, whole_word, whole_filename)
    fold = (lambda s: s) if match_case else str.lower
    words = WORD.findall(fold(text))
    if isinstance(term, Not):
        return not slow_term(term.term, text, *options)
    if isinstance(term, AnyOf):
        return any(slow_term(t, text, *options) for t in term.terms)
    if isinstance(term, Substring):
        wanted = fold(term.text)
        return not wanted or (wanted in words if whole_word else wanted in fold(text))
    if isinstance(term, Regex):
        found = re.compile(term.pattern)
        if not whole_word:
            return bool(found.search(fold(text)))
        firsts = ((w, found.search(w)) for w in words)
        return any(m is not None and m.group() == w for w, m in firsts)
    pattern = fold(term.pattern)
    if whole_filename:
        return slow_glob(fold(text), pattern)
    if whole_word:
        return any(slow_glob(w, pattern) for w in words)
    if not re.search(r"[*?]", pattern):
        return pattern in fold(text)
    return any(slow_glob(fold(text)[i:], pattern) for i in range(len(text)))


def slow_match(row, terms, wanted):
    path, is_dir, size, modified, *_ = row
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1] if "." in name and not is_dir else ""
    fold = (lambda s: s) if wanted["match_case"] else str.lower
    low, high = wanted["size"]
    if wanted["files"] and is_dir or wanted["folders"] and not is_dir:
        return False
    if wanted["ext"] and (is_dir or extension not in wanted["ext"]):
        return False
    if wanted["path"] and fold(wanted["path"]) not in fold(path):
        return False
    if low is not None and size < low or high is not None and size > high:
        return False
    full = bool(wanted["path"]) if wanted["match_path"] is None else wanted["match_path"]
    options = [wanted[o] for o in ("match_case", "whole_word", "whole_filename")]
    return all(slow_term(t, path if full else name, *options) for t in terms)


def random_term(rng, depth=0):
    text = "".join(rng.choices("abAB_. ä9", k=rng.randint(0, 3)))
    kind = rng.choice(["sub", "sub", "glob", "glob", "regex"] + ["not", "any"] * (depth < 2))
    if kind == "sub":
        return Substring(text)
    if kind == "glob":
        return Glob("".join(rng.choices("abAB_.ä**??", k=rng.randint(1, 4))))
    if kind == "regex":
        return Regex(rng.choice(["a+b?", "^a", "b$", "[ab_]+", "a|ab", r"\w\.", "B", r"^\w+$", "ä"]))
    if kind == "not":
        return Not(random_term(rng, depth + 1))
    return AnyOf(*[random_term(rng, depth + 1) for _ in range(rng.randint(1, 3))])


def test_random_searches(spark):
    rng = random.Random(42)
    rows = {}
    for _ in range(250):
        parts = ["".join(rng.choices("abAB_. ä9", k=rng.randint(1, 6))) for _ in range(3)]
        path = "/" + "/".join(parts[: rng.randint(1, 3)])
        rows[path] = (path, rng.random() < 0.2, rng.randint(0, 9), 0, 0, 0)
    rows = list(rows.values())
    searches = []
    for _ in range(120):
        wanted = {
            "files": rng.random() < 0.1,
            "folders": rng.random() < 0.1,
            "ext": rng.choice([[], [], [], ["a", "b", "ab"]]),
            "path": rng.choice([None, None, "a", "B/"]),
            "size": rng.choice([(None, None), (3, None), (None, 6), (2, 7)]),
            "match_case": rng.random() < 0.4,
            "match_path": rng.choice([None, True, False]),
            "whole_word": rng.random() < 0.4,
            "whole_filename": rng.random() < 0.2,
        }
        searches.append(([random_term(rng) for _ in range(rng.randint(0, 2))], wanted))

    from pathlode.functions.paths import with_parts

    data = with_parts(spark.createDataFrame(rows, ENTRY))
    answers = [criteria(terms=terms, **wanted) for terms, wanted in searches]
    # In groups, so that the generated methods stay small.
    got = {row[0]: [] for row in rows}
    for i in range(0, len(answers), 20):
        for r in data.select("path", F.array(*answers[i : i + 20]).alias("a")).collect():
            got[r["path"]] += r["a"]
    found = 0
    for row in rows:
        for answer, (terms, wanted) in zip(got[row[0]], searches):
            assert answer == slow_match(row, terms, wanted), (row, terms, wanted)
            found += answer
    assert found > 1_000


def walk(tree, roots, excludes):
    """Descend from every root, never into what a rule leaves out."""
    seen = set()

    def hidden(name):
        return len(name) > 1 and name.startswith(".")

    def left_out(path):
        name = path.rsplit("/", 1)[-1]
        if excludes.skip_system_paths and path in ("/proc", "/sys", "/dev"):
            return True
        if any(path == p or path.startswith(p.rstrip("/") + "/") for p in excludes.paths):
            return True
        if excludes.skip_hidden and name.startswith("."):
            return True
        if excludes.include_only and not any(slow_glob(name, g) for g in excludes.include_only):
            return True
        if any(slow_glob(name, g) for g in excludes.patterns):
            return True
        globs = [g.removeprefix("**/") for g in excludes.folders]
        return any(slow_glob(part, g) for part in ["/", *path.split("/")[1:]] for g in globs)

    def visit(folder):
        for path, is_dir in tree.items():
            if path.rsplit("/", 1)[0] != folder:
                continue
            above = path.split("/")[1:-1]
            if any(map(hidden, above)) or (is_dir and hidden(path.rsplit("/", 1)[-1])):
                continue
            if left_out(path):
                continue
            seen.add(path)
            if is_dir:
                visit(path)

    for root in roots:
        visit(root.rstrip("/"))
    return sorted(seen)


def test_random_rules(spark):
    rng = random.Random(9)
    names = ["a", "b", ".h", "x.tmp", "proc", "dev", "ab", "b.rs"]
    tree = {}

    def grow(folder, depth):
        for name in rng.sample(names, rng.randint(3, 5)):
            is_dir = depth < 4 and rng.random() < 0.75
            tree[f"{folder}/{name}"] = is_dir
            if is_dir:
                grow(f"{folder}/{name}", depth + 1)

    grow("", 0)
    tree["/proc"], tree["/proc/a"] = True, False
    rows = [(path, is_dir, 0, 0, 0, 0) for path, is_dir in tree.items()]
    data = spark.createDataFrame(rows, ENTRY).coalesce(1).cache()
    folders = [p for p, is_dir in tree.items() if is_dir]
    globs = ["a", "*.tmp", "?", "*b", "b*", "*.rs", "a?", "x*p", "*?", "p*c", "a/b"] * 3 + ["*"]

    def some(most):
        return tuple(rng.sample(globs, rng.choice([0, 0, 0, 1, most])))

    kept = 0
    for _ in range(40):
        excludes = Excludes(
            skip_hidden=rng.random() < 0.5,
            skip_system_paths=rng.random() < 0.5,
            patterns=some(2),
            folders=tuple(rng.choice(["", "**/"]) + g for g in some(1)),
            paths=tuple(rng.sample(folders, rng.choice([0, 0, 0, 2]))),
            include_only=rng.choice([(), (), (), ("*",), ("a*", "b*", "p*"), ("a/b",)]),
        )
        roots = ("/",) if rng.random() < 0.6 else tuple(rng.sample(folders, rng.randint(1, 3)))
        expected = walk(tree, roots, excludes)
        assert paths(build_catalogue(data, roots, excludes)) == expected, (roots, excludes)
        kept += len(expected)
    data.unpersist()
    assert kept > 500
