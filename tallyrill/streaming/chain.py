"""The whole forum ingest: each batch of posts goes through merge, comment rescue, local models and an outside model.

Every step turns its candidates into patches, which are written to a staging
folder once (so fetches, models and calls are not made again by a later read)
while the step's counters are observed. The patches are then merged into the
stored listings, only into the buckets they touch, and that version also holds
the step's name, the batch number and the counters. A batch that is run again
skips the steps that are committed and takes up at the first that is not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrill.functions import text as T
from tallyrill.functions import watches as W
from tallyrill.functions.classify import classify
from tallyrill.operators.merge import KEY, fill_labels, refresh_bundles, rescue, upsert_forum
from tallyrill.operators.rescue import watch_in
from tallyrill.operators.review import THRESHOLDS
from tallyrill.sources.buckets import BucketTable
from tallyrill.sources.commit import names, remove
from tallyrill.sources.feeds import posts_to_listings, typed_posts

from .ingest import _start, with_ids

MOST_COMMENTS, MOST_ASKED, LEAST_CONFIDENCE = 200, 200, 0.75
STEPS = ("merge", "rescue", "local", "outside")


@dataclass(frozen=True)
class Chain:
    """What the steps need; those whose function is missing are left out.

    contexts(candidates) gives threads as feeds.thread_contexts() does, of rows
    with external_id and author. local(rows) gives labels and confidences as
    ml.classify_local() does, of rows with id, title, description. ask(texts)
    gives JSON answers, as classify() takes it.
    """

    table: BucketTable
    staging: str
    source_id: int
    reviews: Callable[[], DataFrame]
    now: Callable[[], Column]
    contexts: Callable[[DataFrame], DataFrame] | None = None
    local: Callable[[DataFrame], DataFrame] | None = None
    ask: Callable[[list[str]], list[str | None]] | None = None
    base_url: str = ""
    most_comments: int = MOST_COMMENTS
    most_asked: int = MOST_ASKED
    least_confidence: float = LEAST_CONFIDENCE

    # ---- steps ------------------------------------------------------------------------------------------------------

    def run(self, posts: DataFrame, number: int) -> dict[str, dict[str, int]]:
        """One batch of raw posts through all steps; the counters of each."""
        counts = {}
        base = self._stage("merge", number, lambda: self._offers(posts), self._offer_counts(), self._merge)
        counts["merge"], offers = base
        # what is no offer is counted, and goes no further; of several versions of a post the last does
        offers = offers.where("_offer").groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in offers.columns if c not in KEY]), "pos").alias("_last")).select(*KEY, "_last.*")
        texts = None
        if self.contexts:
            counts["rescue"], texts = self._stage("rescue", number, lambda: self._rescued(offers), self._rescue_counts(), self._rescue)
        unsure = self._unsure(offers, texts)
        found = None
        if self.local:
            counts["local"], found = self._stage("local", number, lambda: self._local_labels(unsure), {"calls": F.count("*"), "labelled": F.count_if("_labelled")}, self._fill("local"))
            unsure = unsure.join(found.where("_labelled").select("id"), "id", "left_anti")
        if self.ask:
            counts["outside"], _ = self._stage("outside", number, lambda: self._answers(unsure), {"calls": F.count("*"), "labelled": F.count_if("_labelled")}, self._fill("ai"))
        self._clean(number)
        return counts

    def start(self, posts: DataFrame, checkpoint: str, every: str | None = None, report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
        """run() on every batch of a stream of raw posts."""

        def each(batch: DataFrame, number: int) -> None:
            counts = self.run(batch, number)
            if report:
                report(number, counts)

        return _start(posts, each, checkpoint, every)

    # ---- the frame of a step ----------------------------------------------------------------------------------------

    def _path(self, number: int, step: str) -> str:
        return f"{self.staging}/{number:012d}-{step}"

    def _stage(self, step: str, number: int, make: Callable[[], DataFrame], counters: dict[str, Column], apply: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[dict[str, int], DataFrame]:
        spark, path = self.table.spark, self._path(number, step)
        writer = f"{self.source_id}-{step}"
        before = self.table.done(writer, number)
        if before:
            return before.counts, spark.read.parquet(path)
        seen = Observation()
        make().observe(seen, *[c.cast("bigint").alias(k) for k, c in counters.items()]).write.mode("overwrite").parquet(path)
        patches = spark.read.parquet(path)
        counts = {k: v or 0 for k, v in seen.get.items()}
        merged = self.table.merge(patches.where(self._due(patches)), lambda old: apply(old, patches.where(self._due(patches))), writer, number, counts)
        return merged.counts, patches

    @staticmethod
    def _due(patches: DataFrame) -> Column:
        mark = next(c for c in ("_offer", "_patched", "_labelled") if c in patches.columns)
        return F.col(mark)

    def _clean(self, number: int) -> None:
        """Staged patches of batches before this one are not needed any more: only the last batch can be run again."""
        for n in names(self.table.spark, self.staging):
            if n[:12].isdigit() and int(n[:12]) < number:
                remove(self.table.spark, f"{self.staging}/{n}")

    # ---- merge ------------------------------------------------------------------------------------------------------

    def _offers(self, posts: DataFrame) -> DataFrame:
        """Rows for the upsert, with what later steps read again; posts that are no offers are marked."""
        typed = typed_posts(posts)
        rows = posts_to_listings(typed, self.source_id, watch_in(F.col("title")), W.detect_bundle("title", "selftext"), self.base_url)
        own = typed.select(F.col("id").alias("external_id"), F.col("created_utc").alias("pos"), F.col("title").alias("_title"), F.col("selftext").alias("_body"), F.col("link_flair_text").alias("_flair"), F.col("author").alias("_author")).dropDuplicates(["external_id", "pos"])
        one = rows.dropDuplicates(["external_id", "pos"]).withColumn("_offer", F.lit(True))
        out = own.join(one, ["external_id", "pos"], "left").withColumn("_offer", F.coalesce("_offer", F.lit(False)))
        return out.withColumn("source_id", F.lit(self.source_id).cast("bigint")).withColumn("id", F.lit(None).cast("bigint")).transform(with_ids)

    def _offer_counts(self) -> dict[str, Column]:
        offer = F.col("_offer")
        return {"fetched": F.count("*"), "offers": F.count_if(offer), "priced": F.count_if(offer & F.col("price_cents").isNotNull()), "branded": F.count_if(offer & F.col("brand").isNotNull())}

    def _merge(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        plain = rows.select(*[c for c in rows.columns if not c.startswith("_") and c != "id"])
        return with_ids(upsert_forum(old, plain, self.reviews(), self.now()))

    # ---- rescue -----------------------------------------------------------------------------------------------------

    def _rescued(self, offers: DataFrame) -> DataFrame:
        """Patches from the author's comments, for offers that lack something or have a bucket for a price; the newest first."""
        lacking = F.col("price_cents").isNull() | F.col("price_min_cents").isNotNull() | F.col("price_max_cents").isNotNull() | F.col("brand").isNull() | F.col("condition").isNull()
        due = offers.where(lacking).orderBy(F.desc("pos"), "external_id").limit(self.most_comments)
        due = due.select("source_id", "external_id", "id", F.col("_author").alias("author"), "_title", "_body", "_flair")
        threads = self.contexts(due).where("ok").select(F.col("post_id").alias("external_id"), F.col("op_comment").alias("_op"), F.lit(True).alias("_read"))
        rows = due.join(threads, "external_id", "left")
        texts = [F.col(c) for c in ("_title", "_body", "_op")]
        rows = rows.withColumns({"_w": watch_in(*texts), "_exact": T.usd_price_cents(*texts), "_condition": T.condition(*texts), "_era": T.watch_type(*texts), "_sold": T.is_sold(F.col("_title"), F.col("_flair"), F.col("_op"))})
        read = F.coalesce(F.col("_read"), F.lit(False))
        found = F.coalesce(F.col("_w.brand"), F.col("_w.reference"), F.col("_condition"), F.col("_era"), F.col("_exact").cast("string")).isNotNull() | F.col("_sold")
        use = lambda c: F.when(read & found, c)
        return rows.select(
            "source_id", "external_id", "id", read.alias("_read"), (read & (found | (F.coalesce("_op", F.lit("")) != ""))).alias("_patched"), F.col("_op"), use(F.col("_w.brand")).alias("brand"), use(F.col("_w.reference")).alias("reference"),
            use(F.col("_condition")).alias("condition"), use(F.col("_era")).alias("watch_type"), F.coalesce(use(F.col("_sold")), F.lit(False)).alias("is_sold"), F.coalesce(use(F.col("_exact").isNotNull()), F.lit(False)).alias("has_price"),
            use(F.col("_exact")).alias("price_cents"), F.lit(None).cast("bigint").alias("price_min_cents"), F.lit(None).cast("bigint").alias("price_max_cents"), F.lit(None).cast("string").alias("self_text"), F.col("_op").alias("op_comment"),
        )

    @staticmethod
    def _rescue_counts() -> dict[str, Column]:
        return {"attempted": F.count("*"), "read": F.count_if("_read"), "patched": F.count_if("_patched"), "priced": F.count_if("has_price"), "sold": F.count_if("is_sold")}

    def _rescue(self, old: DataFrame, patches: DataFrame) -> DataFrame:
        out = rescue(old, patches.select(*[c for c in patches.columns if not c.startswith("_") and c != "id"]), self.now())
        marked = out.join(patches.select(*KEY, F.lit(True).alias("_seen")), list(KEY), "left")
        bundle = F.when(F.coalesce(F.col("_seen"), F.lit(False)), W.detect_bundle("title", "description")).otherwise(F.col("is_bundle"))
        return refresh_bundles(marked, self.reviews(), bundle).select(*old.columns)

    # ---- labels -----------------------------------------------------------------------------------------------------

    @staticmethod
    def _unsure(offers: DataFrame, texts: DataFrame | None) -> DataFrame:
        """Offers for which no pattern told condition or era: source_id, external_id, id, pos, title, description, op_comment.

        Those that the comments were read for are among them if the comments
        told neither, and then with these; others go without.
        """
        neither = F.col("condition").isNull() & F.col("watch_type").isNull()
        if texts is None:
            rows = offers.where(neither).withColumn("_op", F.lit(None).cast("string"))
        else:
            silent = texts.where(F.col("condition").isNull() & F.col("watch_type").isNull() & (F.coalesce("_op", F.lit("")) != "")).select("id", "_op", F.lit(True).alias("_silent"))
            rows = offers.join(silent, "id", "left").where(neither | F.coalesce("_silent", F.lit(False))).withColumn("_op", F.when(~neither, F.col("_op")))
        return rows.select("source_id", "external_id", "id", "pos", F.col("_title").alias("title"), F.col("_body").alias("description"), F.col("_op").alias("op_comment"))

    def _local_labels(self, unsure: DataFrame) -> DataFrame:
        body = T.joined("\n\n", F.col("description"), F.col("op_comment"))
        found = self.local(unsure.select("id", "title", F.coalesce(body, F.lit("")).alias("description")))
        rows = unsure.select("source_id", "external_id", "id").join(found, "id", "left")
        fields = [f for f in THRESHOLDS if f in found.columns]
        sure = {f: F.coalesce(F.col(f).isNotNull() & (F.col(f"{f}_confidence") >= THRESHOLDS[f]), F.lit(False)) for f in fields}
        least = F.least(*[F.when(sure[f], F.col(f"{f}_confidence")) for f in fields], F.lit(None).cast("double"))
        labels = [x for f in fields for x in (F.when(sure[f], F.col(f)).alias(f), F.when(sure[f], F.floor(F.col(f"{f}_confidence") * 1000 + 0.5) / 1000).cast("decimal(4,3)").alias(f"{f}_confidence"))]
        return rows.select("source_id", "external_id", "id", *labels, (F.floor(least * 100 + 0.5) / 100).cast("decimal(3,2)").alias("local_confidence"), least.isNotNull().alias("_labelled"))

    def _answers(self, unsure: DataFrame) -> DataFrame:
        asked = classify(unsure.orderBy(F.desc("pos"), "external_id").limit(self.most_asked), self.ask)
        some = (F.col("condition").isNotNull() | F.col("watch_type").isNotNull()) & (F.col("confidence") >= self.least_confidence)
        share = lambda c: F.when(F.col(c).isNotNull(), F.floor(F.col("confidence") * 1000 + 0.5) / 1000).cast("decimal(4,3)").alias(f"{c}_confidence")
        whole = (F.floor(F.col("confidence") * 100 + 0.5) / 100).cast("decimal(3,2)").alias("ai_confidence")
        return asked.select("source_id", "external_id", "id", "condition", share("condition"), "watch_type", share("watch_type"), whole, F.coalesce(some, F.lit(False)).alias("_labelled"))

    def _fill(self, by: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
        def apply(old: DataFrame, found: DataFrame) -> DataFrame:
            return fill_labels(old, found.drop("_labelled", "source_id", "external_id"), by, self.now())

        return apply
