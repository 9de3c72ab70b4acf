"""Assemble the tokenization artifacts from OMOP-shaped tables.

``TimelineBuild`` wires the operators together lazily: the event stream, the
demographics, the fitted tables (decile cuts and vocabulary, materialised
with reliable checkpoints because every later plan broadcasts them) and the
long token table. Each artifact is built once per instance.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import events as E
from ..operators import stats, tokenize, vocab
from ..session import cut_lineage
from ..sources import bridge


class TimelineBuild:
    def __init__(self, tables: dict[str, DataFrame], as_of_year: int = 2025,
                 vocab_size: int = K.VOCAB_SIZE, include_visits: bool = True,
                 include_death: bool = True, fit_on: str = "all", split_seed: int = K.SPLIT_SEED,
                 train_ratio: float = K.TRAIN_RATIO):
        if fit_on not in ("all", "train"):
            raise ValueError("fit_on is 'all' or 'train'")
        self.tables = tables
        self.fit_on = fit_on
        self.split_seed = split_seed
        self.train_ratio = train_ratio
        self.as_of_year = as_of_year
        self.vocab_size = vocab_size
        self.include_visits = include_visits
        self.include_death = include_death

    @property
    def spark(self) -> SparkSession:
        return self.tables["person"].sparkSession

    @property
    def parameters(self) -> dict:
        """What a dataset of this build depends on besides its tables."""
        return {k: getattr(self, k) for k in ("as_of_year", "vocab_size", "include_visits", "include_death", "fit_on",
                                              "split_seed", "train_ratio")}

    @cached_property
    def events(self) -> DataFrame:
        """Unified events (T6), before the person filter.

        Written once (K1: the event table): every later plan scans this table, with the
        columns and filters it needs, instead of re-deriving the union of all event tables.
        """
        ev = E.build_events(self.tables, self.include_visits, self.include_death)
        return cut_lineage(ev)

    @cached_property
    def demo(self) -> DataFrame:
        return cut_lineage(E.demographics(self.tables["person"]))

    @cached_property
    def known_events(self) -> DataFrame:
        """Events of persons in the person table."""
        return E.events_of_known_persons(self.events, self.demo)

    @cached_property
    def event_slices(self):
        """K1: the known events clustered by person; what orders or cuts them reads this without a shuffle."""
        return E.clustered_events(self.known_events)

    @cached_property
    def splits(self) -> DataFrame:
        """train/test split of the persons."""
        from ..operators.datasets import person_split

        return cut_lineage(person_split(self.demo, self.train_ratio, self.split_seed))

    def _fitted(self, df: DataFrame) -> DataFrame:
        """The rows that vocabulary and deciles are learned from: all, or the training persons'."""
        if self.fit_on == "all":
            return df
        return df.join(self.splits.where(F.col("split") == "train").select("person_id"), "person_id", "left_semi")

    @cached_property
    def concept_counts(self) -> DataFrame:
        return stats.concept_frequency(self._fitted(self.known_events))

    @cached_property
    def cuts(self) -> DataFrame:
        return cut_lineage(stats.measurement_deciles(self._fitted(self.known_events)).repartition(1))

    @cached_property
    def categories(self) -> DataFrame:
        return stats.distinct_categories(self._fitted(self.known_events), self._fitted(self.demo))

    @cached_property
    def vocab(self) -> DataFrame:
        return vocab.build_vocabulary(self.categories, self.concept_counts, self.vocab_size)

    def tokens_for(self, events: DataFrame, age=None, require_events: bool = False,
                   demo: DataFrame | None = None) -> DataFrame:
        return tokenize.timeline_tokens(
            events, demo if demo is not None else self.demo, self.vocab, self.cuts,
            as_of_year=self.as_of_year, age=age, require_events=require_events,
        )

    @cached_property
    def tokens(self) -> DataFrame:
        """Long token table of every person (Z1-Z4), materialised once (K2: the saved
        sequences)."""
        return cut_lineage(self.tokens_for(self.events))

    @cached_property
    def arrays(self) -> DataFrame:
        return tokenize.timeline_arrays(self.tokens)

    def split_events(self, cut: str) -> tuple[DataFrame, DataFrame]:
        """Events before ``cut`` (current) and at/after it (future)."""
        ts = F.col("ts")
        c = F.to_timestamp_ntz(F.lit(cut))
        return self.events.where(ts < c), self.events.where(ts >= c)


_CACHE: dict[tuple, TimelineBuild] = {}


def build_for(spark: SparkSession, sf_dir: str, source: str, **kw) -> TimelineBuild:
    """Memoised build over a bridge of the driver tables (one per session, dir and bridge)."""
    key = (spark.sparkContext.applicationId, sf_dir, source, tuple(sorted(kw.items())))
    b = _CACHE.get(key)
    if b is None:
        b = TimelineBuild(bridge.load_bridge(spark, sf_dir, source), **kw)
        _CACHE[key] = b
    return b


def clear_builds() -> None:
    """Forget all builds, for example after the input tables have changed."""
    _CACHE.clear()


def write_outputs(build: TimelineBuild, out_dir: str, tag: str | None = None, seed: int = K.SPLIT_SEED,
                  train_ratio: float = K.TRAIN_RATIO, force: bool = True, concept: DataFrame | None = None,
                  input_root: str | None = None) -> str:
    """Write the processed dataset the way the original pipeline lays it out (K1-K6, K8):
    partitioned events, token sequences per split, vocabulary, decile cuts, split
    lists, the tokenization spec and the reports. Returns the folder.

    Sequences are written in chunks of bounded length (A25). With ``force=False`` a dataset that
    its manifest calls finished, with the same parameters and (where ``input_root`` names their
    folder) inputs, and whose tables hold the rows named there, is kept as it is (K9); anything
    else, one without patients too, is built anew."""
    from ..operators import datasets as D
    from ..operators import profile as P
    from ..sources import sinks as S

    root, spark = S.dataset_path(out_dir, tag), build.spark
    parameters = {**build.parameters, "seed": seed, "split_ratio": train_ratio, "concepts": concept is not None}
    inputs = S.folder_state(spark, input_root) if input_root else None
    if not force and S.is_finished(spark, root, parameters, inputs):
        return root
    S.write_manifest(spark, root, False, parameters, inputs)
    S.write_events_partitioned(build.known_events, f"{root}/events_partitioned")
    splits = D.person_split(build.demo, train_ratio, seed)
    S.write_table(splits, f"{root}/splits")
    S.write_sequences(tokenize.timeline_chunks(build.tokens), splits, f"{root}/sequences")
    S.write_table(build.vocab.select("token", "token_id"), f"{root}/vocabulary")
    S.write_table(build.cuts, f"{root}/quantiles")
    S.write_spec(build.vocab, f"{root}/tokenization_spec")
    report = P.vocab_report(build.vocab, build.tokens)
    S.write_vocab_report(report, f"{root}/vocabulary_report_tsv")
    S.write_vocab_text(report, f"{root}/vocabulary_report_txt")
    S.write_csv(P.lengths(build.tokens), f"{root}/timeline_lengths_csv")
    if concept is not None:
        S.write_csv(P.top_token_report(build.tokens, build.vocab, concept), f"{root}/top_tokens_csv")
    else:
        S.write_csv(P.top_tokens(build.tokens, build.vocab, K.REPORT_TOP_K), f"{root}/top_tokens_csv")
    S.write_manifest(spark, root, True, parameters, inputs, [
        "events_partitioned", "splits", "sequences", "vocabulary", "quantiles", "tokenization_spec",
        "vocabulary_report_tsv", "vocabulary_report_txt", "timeline_lengths_csv", "top_tokens_csv"])
    return root
