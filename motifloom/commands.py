"""The library as commands, run from left to right.

    python -m motifloom.commands -addSequence a.fa -addMatrix 'm/*.pfm' -getTFBSabsolute 9 -savematch hits.gff

A command is a word after a dash; what follows up to the next one are its
arguments, of which `.` stands for the default. Commands change a workspace of
DataFrames; nothing is computed before a command shows or saves it, or needs it.
Paths are Spark paths, globs included; saved files are folders of text parts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.penalty import Weights
from .operators import background as B
from .operators import chain, compare, merge, scan, stats, threshold, tree
from .operators import motifs as M
from .operators import sites as S
from .sinks import gff, text
from .sources import gff as read
from .sources.motifs import read_motifs
from .sources.sequences import describe, read_sequences
from .sources.trees import parse_newick
from .storage import stored

CHUNK = 1_000_000


class CommandError(ValueError):
    """A command that can't be carried out."""


class Workspace:
    def __init__(self, spark: SparkSession, out: Callable[[str], None] = print) -> None:
        self.spark, self.out = spark, out
        self.sequences: DataFrame | None = None
        self.motifs: DataFrame | None = None
        self.frequencies, self.markov, self.pseudocount = M.UNIFORM, None, 1.0
        self.reset()

    # --- sequences and motifs

    def reset(self) -> None:
        """Forget all sequences, motifs and results."""
        self.reset_sequences()
        self.motifs = None

    def reset_results(self) -> None:
        self.sites = self.columns = self.pairwise = self.merged = None
        self.nodes: dict[int, DataFrame] = {}
        self.last: tuple | None = None

    def reset_sequences(self) -> None:
        self.sequences = None
        self.reset_results()

    def reset_matrices(self) -> None:
        self.motifs = None
        self.reset_results()

    def add_matrix(self, *paths: str) -> None:
        new = read_motifs(self.spark, list(paths))
        self.motifs = new if self.motifs is None else self.motifs.unionByName(new.join(self.motifs.select("motif").distinct(), "motif", "left_anti"))
        self.reset_results()

    def remove_matrix(self, index: str) -> None:
        self.motifs = S.without_motif(self._motifs(), int(index))
        self.reset_results()

    def add_sequence(self, *paths: str) -> None:
        new = read_sequences(self.spark, list(paths) if len(paths) > 1 else paths[0])
        if self.sequences is not None:
            new = self.sequences.join(new.select("seq_id"), "seq_id", "left_anti").unionByName(new)
        self.sequences = new

    def remove_sequence(self, *patterns: str) -> None:
        for p in patterns:
            self.sequences = S.without_sequences(self._sequences(), p, "seq_id")
            if self.sites is not None:
                self.sites = S.without_sequences(self.sites, p)

    def _sequences(self) -> DataFrame:
        if self.sequences is None:
            raise CommandError("no sequences")
        return self.sequences

    def _motifs(self) -> DataFrame:
        if self.motifs is None:
            raise CommandError("no matrices")
        return self.motifs

    def _derived(self) -> DataFrame:
        return M.derived(self._motifs(), self.frequencies, self.pseudocount)

    def print_matrices(self) -> None:
        self._show(M.wide(self._motifs()).orderBy("motif", "pos"))

    def print_matrix_weights(self) -> None:
        self._show(M.wide(self._derived(), "weight").orderBy("motif", "pos"))

    def print_sequence_names(self) -> None:
        self._show(describe(self._sequences()).select("seq_id", "short").orderBy("seq_id"))

    def _show(self, rows: DataFrame) -> None:
        for r in rows.toLocalIterator():
            self.out("\t".join("" if v is None else str(v) for v in r))

    # --- backgrounds

    def set_frequencies(self, *given: str) -> None:
        """Four frequencies, or the name of a sequence to count them in."""
        if len(given) == 4:
            shares = [float(x) for x in given]
        else:
            rows = B.base_frequencies(self._one(given[0])).collect()
            shares = [r["freq"] for r in rows]
        if not all(x and x > 0 for x in shares):
            raise CommandError("a base without a frequency")
        self.frequencies, self.markov = tuple(x / sum(shares) for x in shares), None
        self.reset_results()

    def _one(self, name: str) -> DataFrame:
        own = self._sequences().where(F.col("seq_id") == name)
        if own.isEmpty():
            raise CommandError(f"no sequence {name}")
        return own

    def set_markov(self, source: str, order: str = "4") -> None:
        """A sequence to count grams in, or a file of counts."""
        if self.sequences is not None and not self.sequences.where(F.col("seq_id") == source).isEmpty():
            self.markov = B.gram_vector(B.gram_counts(self._one(source), int(order)), int(order))
        else:
            self.markov = B.load_background("".join(r["value"] for r in self.spark.read.text(source, wholetext=True).collect()))
            B.grams_of_vector(self.spark, self.markov)
        self.reset_results()

    def save_markov(self, path: str) -> None:
        if self.markov is None:
            raise CommandError("no Markov background")
        self.spark.createDataFrame([(B.save_background(self.markov),)], "value string").coalesce(1).write.text(path)

    def set_pseudocount(self, value: str = "1.0") -> None:
        self.pseudocount = float(value) if float(value) > 0 else 1.0
        self.reset_results()

    # --- scan

    def scan(self, kind: str, value: str) -> None:
        derived = self._derived()
        plain = M.matrices(derived, "weight")
        cut = threshold.cutoffs(plain, kind, float(value), self.frequencies)
        widest = max(w.shape[1] for w in plain.values())
        if self.markov is None:
            found = scan.scan(scan.chunked(self._sequences(), CHUNK, widest - 1), plain, cut)
        else:
            found = scan.scan(self._sequences(), M.matrices(derived, "positive_weight"), cut, self.markov)
        self.reset_results()
        self.sites = stored(found, "sites")
        for r in S.match_counts(self.sites).orderBy(F.col("seq").asc_nulls_last()).toLocalIterator():
            self.out(f"{r['seq'] or 'total'}\t{r['n']}")

    def _sites(self, path: str = ".") -> DataFrame:
        if path != ".":
            return read.read_sites(self.spark, path)
        if self.sites is None:
            raise CommandError("no matches")
        return self.sites

    def show_matches(self) -> None:
        self._show(gff.site_lines(self._sites()))

    def save_matches(self, path: str) -> None:
        gff.write_lines(gff.site_lines(self._sites()), path)

    def head(self, n: str) -> None:
        self.sites = S.head(self._sites(), int(n))

    def randomize(self, seed: str = "0") -> None:
        self.sites = stored(S.randomised(self._sites(), int(seed)), "sites")

    # --- alignment

    def _names(self, sites: DataFrame) -> list[str]:
        return sorted(r["seq"] for r in sites.select("seq").distinct().collect())

    def _aligned(self, sites: DataFrame, names: list[str], n: int, w: Weights, **how) -> None:
        sites = stored(sites.select("seq", "motif", "begin", "end", "score", "strand"), "align-sites")
        self.last = (sites, names, n, w, how)
        self.weights = w
        self.columns = stored(chain.align(sites, names, n, w, **how), "columns")

    def align(self, path: str = ".", n: str = "3", *rest: str) -> None:
        sites = self._sites(path)
        names = [x for x in rest[5:7] if x != "."] or self._names(sites)
        if len(names) != 2:
            raise CommandError(f"two sequences are needed, not {len(names)}; name them")
        self._aligned(sites, names, _number(n, 3), _weights(rest[:5]))

    def more(self, n: int, keep_scores: bool) -> None:
        """n further modules: from scores worked out anew, or from the same scores."""
        if self.last is None:
            raise CommandError("no alignment")
        sites, names, had, w, how = self.last
        self._aligned(sites, names, had + n, w, **how | {"keep_scores": keep_scores})

    def down_to(self, score: str) -> None:
        if self.last is None:
            raise CommandError("no alignment")
        sites, names, n, w, how = self.last
        self._aligned(sites, names, n, w, **how | {"down_to": float(score)})

    def align_many(self, path: str = ".", n: str = "3", *rest: str) -> None:
        sites = self._sites(path)
        self._aligned(sites, self._names(sites), _number(n, 3), _weights(rest))

    def align_short(self, path: str, gaps: str = "0", n: str = "3", *rest: str) -> None:
        sites = self._sites(path)
        self._aligned(sites, self._names(sites), _number(n, 3), _weights(rest), bonus="chain", gap_limit=_number(gaps, 0))

    def align_from_pairs(self, path: str, pairs: str, gaps: str = "0", n: str = "1", buffer: str = "1000", *rest: str) -> None:
        sites = self._sites(path)
        self.pairwise = read.read_modules(self.spark, pairs)
        w = _weights(rest)
        near = chain.align_near_pairs(sites, self.pairwise[0], self._names(sites), _number(gaps, 0), _number(n, 1), _number(buffer, 1000), w)
        self.weights, self.columns = w, stored(near, "columns")

    def align_tree(self, path: str, tree_path: str, method: str = "1", k: str = "100", n: str = "3", *rest: str) -> None:
        sites = stored(self._sites(path).select("seq", "motif", "begin", "end", "score", "strand"), "align-sites")
        line = self.spark.read.text(tree_path).first()["value"]
        root = parse_newick(line, set(self._names(sites)))
        how = {"1": "pairs", "2": "general", "3": "representative"}[method if method != "." else "1"]
        self.weights = _weights(rest)
        self.nodes = tree.align_tree(sites, root, how, _number(k, 100), self.weights)
        self.columns = tree.node_alignments(self.nodes, root.number, _number(n, 3))

    def node(self, number: str, n: str = "3") -> None:
        self._show(tree.node_alignments(self.nodes, int(number), _number(n, 3)).orderBy("module", "col", "seq"))

    def merge_pairs(self, *paths: str) -> None:
        modules, sites = read.read_modules(self.spark, list(paths))
        number = F.dense_rank().over(_by("file", "module")).cast("long")
        known = modules.select("file", "module").distinct().withColumn("number", number)
        sites = stored(sites.join(known, ["file", "module"]).drop("module").withColumnRenamed("number", "module"), "pair-sites")
        scores = modules.join(known, ["file", "module"]).groupBy(F.col("number").alias("module")).agg(F.max("score").alias("score"))
        self.merged = stored(merge.merge_modules(sites, scores), "merged")

    def _columns(self) -> DataFrame:
        if self.columns is None:
            raise CommandError("no alignment")
        return self.columns

    def _module_texts(self) -> DataFrame:
        return text.module_texts(self._columns(), self.sequences).orderBy("module").select("value")

    def _module_lines(self) -> DataFrame:
        columns = self._columns()
        model = stats.expectation_model(columns.groupBy("module").agg(F.max("module_score").alias("score")))
        return gff.module_lines(columns, self.weights, self.sequences, model, self.sequences)

    def save_anchors(self, path: str) -> None:
        x, y = self._names(self._columns())[:2]
        gff.write_lines(gff.anchor_lines(self._columns(), x, y).orderBy("module", "col"), path)

    def _base_lines(self) -> DataFrame:
        if self.pairwise is None:
            raise CommandError("no pairwise modules")
        marked = text.pairwise_base(self.pairwise[1].withColumn("cum_score", F.col("delta")), self._columns()).orderBy("module", "col", "seq")
        return marked.select(F.concat_ws("\t", F.when(F.col("used"), "!").otherwise(""), "module", "col", "seq", "motif", "begin", "end", "strand").alias("value"))

    def _merged_texts(self, least: str = "0") -> DataFrame:
        if self.merged is None:
            raise CommandError("no merged alignment")
        return text.merged_texts(self.merged, int(least)).orderBy("component", "nth").select("value")

    def save_matrix(self, path: str, pairs: DataFrame, value: str) -> None:
        compare.as_matrix(pairs, value).coalesce(1).write.csv(path, sep="\t", header=True)

    # --- running

    def run(self, words: list[str]) -> None:
        """Commands with their arguments, as on a command line."""
        calls: list[tuple[str, list[str]]] = []
        for word in words:
            if word[:1] == "-" and (word[1:2].isalpha() or word[1:2] in ("_", "?")):
                calls.append((word[1:], []))
            elif calls:
                calls[-1][1].append(word)
            else:
                raise CommandError(f"not a command: {word}")
        for name, args in calls:
            self.execute(name, args)

    def execute(self, name: str, args: list[str]) -> None:
        if name not in COMMANDS:
            raise CommandError(f"unknown command: {name}")
        least, call = COMMANDS[name]
        if len(args) < least:
            raise CommandError(f"{name} needs {least} arguments at least")
        call(self, *args)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # of modules, not of their sites


def _number(text_: str, default: int) -> int:
    return default if text_ == "." else int(text_)


def _weights(given: tuple[str, ...]) -> Weights:
    """lambda, xi, mu, nu and nucleotides a turn; the default for . and for what is left out."""
    names = ("lam", "xi", "mu", "nu", "rotation")
    return Weights(**{k: float(v) for k, v in zip(names, given, strict=False) if v != "."})


def _help(ws: Workspace, *names: str) -> None:
    for name in names or sorted(n for n in COMMANDS if n[0] != "_"):
        least, _ = COMMANDS.get(name, (0, None))
        ws.out(f"{name}\tat least {least} arguments" if name in COMMANDS else f"unknown command: {name}")


_W = Workspace
#: name: least number of arguments, what it does.
COMMANDS: dict[str, tuple[int, Callable]] = {
    "about": (0, lambda ws: ws.out(__doc__ or "")),
    "help": (0, _help),
    "addMatrix": (1, _W.add_matrix), "removeMatrix": (1, _W.remove_matrix), "resetMatrices": (0, _W.reset_matrices), "printMatrices": (0, _W.print_matrices), "printMatrixWeights": (0, _W.print_matrix_weights),
    "addSequence": (1, _W.add_sequence), "addSingleSequence": (1, _W.add_sequence), "removeSequence": (1, _W.remove_sequence), "resetSequences": (0, _W.reset_sequences), "reset": (0, _W.reset), "printSeqNames": (0, _W.print_sequence_names),
    "setBGfreq": (1, _W.set_frequencies), "setMarkovBG": (1, _W.set_markov), "saveMarkovBackground": (1, _W.save_markov), "setpseudocount": (1, _W.set_pseudocount),
    "getTFBS": (0, lambda ws, v="0.1": ws.scan("relative", v)), "getTFBSabsolute": (0, lambda ws, v="9.0": ws.scan("absolute", v)), "getTFBSpvalue": (0, lambda ws, v="1e-6": ws.scan("pvalue", v)),
    "showmatch": (0, _W.show_matches), "savematch": (1, _W.save_matches),
    "align": (0, _W.align), "more": (0, lambda ws, n="1": ws.more(int(n), True)), "suboptimals": (0, lambda ws, n="1": ws.more(int(n), False)), "suboptimalsDownTo": (1, _W.down_to),
    "showalign": (0, lambda ws: ws._show(ws._module_texts())), "savealign": (1, lambda ws, path: gff.write_lines(ws._module_texts(), path)),
    "savealignGFF": (1, lambda ws, path: gff.write_lines(ws._module_lines(), path)), "savealignAnchor": (1, _W.save_anchors),
    "showpwbase": (0, lambda ws: ws._show(ws._base_lines())), "savepwbase": (1, lambda ws, path: gff.write_lines(ws._base_lines(), path)),
    "multipleAlign": (0, _W.align_many), "shortMultipleAlign": (1, _W.align_short), "multiFromPairwise": (2, _W.align_from_pairs), "treeMultipleAlign": (2, _W.align_tree), "nodeAlignments": (1, _W.node),
    "computeKLdistances": (1, lambda ws, path: ws.save_matrix(path, compare.relative_entropy(ws._motifs(), ws.frequencies, ws.pseudocount), "distance")),
    "__computeEscores": (1, lambda ws, path: ws.save_matrix(path, compare.expected_score(ws._motifs(), ws.frequencies, ws.pseudocount), "score")),
    "__multipleAlignGreedy": (1, _W.merge_pairs), "__showMultiAlign": (0, lambda ws, least="0": ws._show(ws._merged_texts(least))), "__saveMultiAlign": (1, lambda ws, path, least="0": gff.write_lines(ws._merged_texts(least), path)),
    "__head": (1, _W.head), "__randomize_full": (0, _W.randomize),
}
for _short, _long in {"h": "help", "?": "help", "am": "addMatrix", "rm": "removeMatrix", "resm": "resetMatrices", "pm": "printMatrices", "pmw": "printMatrixWeights", "as": "addSequence", "ass": "addSingleSequence", "rs": "removeSequence", "ress": "resetSequences", "ps": "printSeqNames", "sm": "showmatch", "sa": "showalign"}.items():
    COMMANDS[_short] = COMMANDS[_long]


if __name__ == "__main__":
    from .session import build

    try:
        Workspace(build()).run(sys.argv[1:])
    except CommandError as e:
        sys.exit(str(e))
