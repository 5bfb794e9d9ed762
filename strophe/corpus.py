"""One object for a corpus: tables in, a DataFrame for each question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strophe.operators import association, frequency, lexical, library, plays, runs, search, timeline
from strophe.plans import scope, stream
from strophe.sources import tables


@dataclass
class Corpus:
    """``songs``, ``lines`` and the graph tables a question needs; ``tokens`` may bring a tagger's own tokens."""

    songs: DataFrame
    lines: DataFrame
    works: DataFrame | None = None
    credits: DataFrame | None = None
    people: DataFrame | None = None
    plays: DataFrame | None = None
    tokens: DataFrame | None = None

    @classmethod
    def at(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        return cls(*(f(spark, sf_dir) for f in (tables.songs, tables.lines, tables.works, tables.credits, tables.people, tables.plays)))

    def within(self, subcorpus: scope.Subcorpus) -> Corpus:
        """The corpus of the songs that a sub-corpus holds."""
        songs = self.songs.where(subcorpus.condition())
        keep = songs.select("song_id").distinct()
        part = lambda df: None if df is None else df.join(keep, "song_id", "left_semi")
        return Corpus(songs, part(self.lines), self.works, self.credits, self.people, part(self.plays), part(self.tokens))

    def without(self, removed: DataFrame) -> Corpus:
        """The corpus without songs that have a tombstone."""
        part = lambda df: None if df is None else scope.live(df, removed)
        return Corpus(part(self.songs), part(self.lines), self.works, self.credits, self.people, part(self.plays), part(self.tokens))

    def stream(self, jp_only: bool = False) -> DataFrame:
        return self.tokens if self.tokens is not None else stream.stream(self.lines, scope.Scope(jp_only=jp_only))

    def frequency(self, **options) -> DataFrame:
        return frequency.frequency(self.stream(), **options)

    def dispersion(self, unit: str = scope.TOKENS) -> DataFrame:
        return frequency.dispersion(self.stream(), ["lemma", "pos"], unit)

    def ngrams(self, n: int = 2, **options) -> DataFrame:
        return frequency.ngrams(self.stream(), n, **options)

    def report(self) -> DataFrame:
        return frequency.report_totals(self.lines, self.stream())

    def collocations(self, node: str, **options) -> DataFrame:
        return association.collocations(self.stream(), node, **options)

    def network(self, node: str, **options) -> DataFrame:
        return association.network(self.stream(), node, **options)

    def keyness(self, reference: Corpus, **options) -> DataFrame:
        return association.keyness(self.stream(), reference.stream(), **options)

    def breakdown(self, words: tuple[str, ...], by: str = "artist") -> DataFrame:
        return association.breakdown(self.stream(), words, by)

    def lexical(self, by: str = "song_id", **options) -> DataFrame:
        return lexical.richness(self.stream(), by, **options)

    def kwic(self, *keywords: str, **options) -> DataFrame:
        return search.kwic(self.lines, keywords, **options)

    def pattern(self, *items: search.Item, **options) -> DataFrame:
        return search.pattern_search(self.lines, list(items), **options)

    def full_text(self, phrase: str, limit: int | None = None) -> DataFrame:
        return search.full_text(self.lines, phrase, limit)

    def overview(self) -> DataFrame:
        return library.overview(self.works, self.credits)

    def people_directory(self) -> DataFrame:
        return library.people_directory(self.people, self.credits, self.works)

    def most_played(self, **options) -> DataFrame:
        return plays.most_played(self.plays, **options)

    def line_issues(self) -> DataFrame:
        """Of lines with time_sec."""
        return timeline.line_issues(self.lines)

    def snapshot(self) -> DataFrame:
        return runs.snapshot(self.lines, self.stream())
