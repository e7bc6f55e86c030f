"""Public-suffix rules as a trie that a column expression walks.

The rules of a public-suffix list form a trie over the labels of a name, last label first: `co.uk` is
the node `co` below `uk`. A node carries up to three marks: a rule ends here, every label below it is
a suffix too (`*.`), or it is an exception (`!`). A node is known by its dotted name, so the nodes of
each depth are kept as one array of buckets by the hash of that name: a walk looks up the last label, the
last two and so on, one bucket each, in generated code. The arrays are constants of the plan whose size is
measured when they are built, and a walk names each once: plans are copied and printed by the driver.
There is no join and no second scan, so the walk also works in streams.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A trie may be a constant of the plan up to this many bytes; larger rule tables are joined.
TRIE_BYTES = 4 << 20
_ENDS, _BELOW, _EXCEPTION = 1, 2, 4
_PREVAILS = 1 << 20  # added to an exception's labels


@dataclass(frozen=True)
class SuffixTrie:
    """For each depth, buckets of ",name:marks," of the nodes with so many labels."""

    levels: tuple[tuple[str, ...], ...]

    @property
    def depth(self) -> int:
        return len(self.levels)

    @property
    def size(self) -> int:
        return sum(len(b.encode()) + 1 for level in self.levels for b in level)

    @classmethod
    def of(cls, rules: Iterable[str]) -> SuffixTrie:
        """From rules as a list file has them: `co.uk`, `*.ck`, `!www.ck`. Names outside ASCII count in
        their IDNA form as well."""
        marks: dict[str, int] = {}
        for rule in rules:
            rule = rule.strip().lower()
            mark = _EXCEPTION if rule.startswith("!") else _BELOW if rule.startswith("*.") else _ENDS
            name = rule.removeprefix("!").removeprefix("*.").strip(".")
            for form in {name, _idna(name)} - {""}:
                marks[form] = marks.get(form, 0) | mark
        levels: list[dict[str, int]] = [{} for _ in range(max((n.count(".") + 1 for n in marks), default=1))]
        for name, mark in marks.items():
            levels[name.count(".")][name] = mark
        return cls(tuple(_hashed(level) for level in levels))

    def marks(self, name: Column, labels: int) -> Column:
        """The marks of a node of so many labels, a digit as text; '' where there is no such node."""
        buckets = self.levels[labels - 1]
        constant = F.split(F.lit("\n".join(buckets)), "\n")
        bucket = F.element_at(constant, (F.crc32(name.cast("binary")) % len(buckets) + 1).cast("int"))
        return F.substring(F.split_part(F.concat(bucket, F.lit(",")), F.concat(F.lit(","), name, F.lit(":")), F.lit(2)), 1, 1)

    def marked(self, host: Column) -> Column:
        """The host with marks in front where labels may lack, so that every step of the walk can be
        taken for every host."""
        return F.concat(F.lit("!." * (self.depth + 2)), host)

    def registered(self, marked: Column, brand_tld: bool) -> Column:
        """The suffix of a marked host and one label; for a host that is a suffix the host, or '' without
        `brand_tld`. An exception's suffix is its name less one label, else the longest rule counts, else
        the last label. Null for one label that no rule names."""
        last = lambda n: F.substring_index(marked, ".", -n)
        there = lambda n: ~last(n).startswith("!")
        found = []
        for d in range(1, self.depth + 1):
            below = F.when(there(d + 1), d + 1)
            worth = F.array(F.lit(d), F.coalesce(below, F.lit(1)), F.coalesce(below, F.lit(d)), *[F.lit(_PREVAILS + d - 1)] * 4)
            node = F.get(worth, F.ascii(self.marks(last(d), d)) - ord("1"))
            found.append(F.when(there(d), node) if d > 2 else node)  # most hosts end before the deepest rules
        suffix = F.greatest(F.when(there(2), 1), *found)
        cut = F.call_function("substring_index", marked, F.lit("."), -(suffix % _PREVAILS + 1))
        return F.replace(cut, F.lit("!."), F.lit("")) if brand_tld else F.split_part(cut, F.lit("!."), F.lit(1))


def _hashed(marks: dict[str, int]) -> tuple[str, ...]:
    """About as many buckets as names, a power of two."""
    count = 1 << max(0, len(marks) - 1).bit_length()
    held: list[list[str]] = [[] for _ in range(count)]
    for name, mark in sorted(marks.items()):
        held[zlib.crc32(name.encode()) % count].append(f"{name}:{mark}")
    return tuple("".join(f",{x}" for x in b) for b in held)


def _idna(name: str) -> str:
    try:
        return name.encode("idna").decode()
    except UnicodeError:
        return name


def from_list(lines: Iterable[str], *, private: bool = False) -> SuffixTrie:
    """A trie from the lines of a public-suffix file. Rules after the mark of the private section are
    left out unless asked for."""
    rules, own = [], False
    for line in lines:
        if "===BEGIN PRIVATE DOMAINS===" in line:
            own = True
        elif "===END PRIVATE DOMAINS===" in line:
            own = False
        elif line.strip() and not line.strip().startswith("//") and (private or not own):
            rules.append(line.split()[0])
    return SuffixTrie.of(rules)


def from_table(rules: DataFrame) -> SuffixTrie | None:
    """A trie from rows (rule, suffix_labels, rank) as `urls.read_suffix_rules` makes them; None if the
    table's measured size is beyond the bound. Its size is measured before it is read."""
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 4), F.lit(0))).first()[0]
    if size > TRIE_BYTES:
        return None
    made = []
    for rule, n, rank in rules.select("rule", "suffix_labels", "rank").collect():
        labels = rule.count(".") + 1
        made.append(("!" if rank == 2 else "*." if n > labels else "") + rule)
    return SuffixTrie.of(made)


@cache
def _of_runtime(home: str, private: bool) -> SuffixTrie | None:
    path = Path(home) / "lib" / "security" / "public_suffix_list.dat"
    if not path.is_file():
        return None
    rules = []
    with zipfile.ZipFile(path) as parts:  # one entry per top-level name; each line is led by its section
        for entry in parts.namelist():
            for line in parts.read(entry).decode("utf-8").splitlines():
                if line[1:] and (private or line[0] == "\0"):
                    rules.append(line[1:])
    return SuffixTrie.of(rules)


def installed(spark: SparkSession | None = None, *, private: bool = False) -> SuffixTrie | None:
    """The public-suffix list that comes with the Java runtime of the session; None if it has none."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or not hasattr(spark, "_jvm"):
        return None
    return _of_runtime(spark._jvm.java.lang.System.getProperty("java.home"), private)
