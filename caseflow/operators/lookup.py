"""Statements, current status, channel logs, and the two keyword searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.contained import finder
from caseflow.functions.text import SPACES, strip
from caseflow.operators.ordered import HOT_ROWS
from caseflow.operators.skew import spread_join
from caseflow.session import work_dir

CREDIT_LIMIT = 25_000.00
GRAM = 3
# A list up to this length is sent to every task.
LISTED_ROWS = 250_000
# A list of words up to this length and size is.
LISTED_WORDS, LISTED_BYTES = 250_000, 64 << 20
# Below this, one file may be a single task's work, and dealing it out costs little.
SMALL_BYTES = 1 << 30


def cents(amount: Column) -> Column:
    """Whole cents, so that sums do not depend on the order rows arrive in."""
    return F.round(amount * 100).cast("long")


def account_statement(
    accounts: DataFrame, transactions: DataFrame, n: int = 3, limit: float = CREDIT_LIMIT
) -> DataFrame:
    """Each account's balance, available credit and ``n`` latest transactions, one row per one.

    Filtering ``row_number`` by a constant lets Spark keep only ``n`` rows per account and task
    before the shuffle, so a hot account sends few rows.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.desc("ts"), F.desc("transaction_id"))
    recent = (
        transactions.select("customer_id", "transaction_id", "ts", "amount", "status")
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= n)
    )
    totals = transactions.groupBy("customer_id").agg(
        F.sum(cents(F.col("amount"))).alias("balance_cents"), F.count(F.lit(1)).alias("transactions")
    )
    limit_cents = round(limit * 100)
    balance = F.coalesce(F.col("balance_cents"), F.lit(0))
    return (
        accounts.select("customer_id")
        .join(totals, "customer_id", "left")
        .join(recent, "customer_id", "left")
        .select(
            "customer_id",
            (balance / 100.0).alias("current_balance"),
            ((F.lit(limit_cents) - balance) / 100.0).alias("available_credit"),
            F.coalesce("transactions", F.lit(0)).alias("transactions"),
            "recency",
            "transaction_id",
            "ts",
            "amount",
            "status",
        )
    )


def card_status(statuses: DataFrame) -> DataFrame:
    """Current status per customer with what it allows; ties in time are settled by id."""
    latest = statuses.groupBy("customer_id").agg(
        F.max(F.struct("status_ts", "status_id", "status")).alias("s"),
        F.count(F.lit(1)).alias("changes"),
    )
    locked = F.col("s.status") == "LOCKED"
    return latest.select(
        "customer_id",
        F.col("s.status").alias("status"),
        F.when(locked, "DECLINE_EVENT").alias("lock_reason"),
        F.col("s.status_ts").alias("since"),
        F.col("s.status_id").alias("status_id"),
        "changes",
        locked.alias("replacement_eligible"),
        (~locked).alias("wallet_eligible"),
    )


def channel_activity(signals: DataFrame, channel: str) -> DataFrame:
    """One channel's log per customer; the filter reaches the scan."""
    return (
        signals.filter(F.col("channel") == channel)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.sum(cents(F.col("amount"))).alias("amount_cents"),
            F.countDistinct("location_id").alias("locations"),
        )
        .withColumn("channel", F.lit(channel))
    )


def channel_summary(signals: DataFrame) -> DataFrame:
    """What every channel holds of every customer; the counts combine in the tasks."""
    return signals.groupBy("customer_id", "channel").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(cents(F.col("amount"))).alias("amount_cents"),
    )


def channel_logs(signals: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The log rows of the given channels; the filter and the columns reach the scan."""
    return signals.filter(F.col("channel").isin(list(channels))).select(
        "customer_id", "channel", "signal_id", "ts", "location_id", "amount"
    )


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """All distinct substrings of the given numbers of characters, and shorter ones from the text's end.

    The text is read once, for the longest; shorter ones are the beginnings of those.
    """
    whole = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)))

    def shortened(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda gram: F.left(gram, F.lit(n)))

    parts = F.transform(F.array(whole), lambda grams: F.concat(*[shortened(grams, n) for n in sizes]))
    return F.array_distinct(F.flatten(parts))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(df: DataFrame) -> DataFrame:
    """A join's side, sent to every task where it is counted to be short."""
    return F.broadcast(df) if df.count() <= LISTED_ROWS else df


def _dealt(df: DataFrame, id_column: str) -> DataFrame:
    """A small input in few files dealt to all cores; a larger one has enough pieces and is left as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SMALL_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, F.xxhash64(id_column))


def substring_hits(
    texts: DataFrame, words: DataFrame, keys: Sequence[str], id_column: str, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(keys, word, id): which texts contain which words.

    ``texts`` has the keys, an id and ``fields``, an array of texts to look in; ``words`` the keys and ``word``,
    not empty. A word is looked for in the texts with the same keys.

    A list of words that is counted to be short is indexed by the words' beginnings and sent to every task, and each
    text is read once, past that index. A longer list stays where it is; there the texts are indexed.
    """
    words = _stored(words.where("word IS NOT NULL").select(*keys, "word").distinct(), "words")
    count, size = words.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if count <= LISTED_WORDS and (size or 0) <= LISTED_BYTES:
        return _listed_hits(texts, words, keys, id_column, hot_rows)
    return _indexed_hits(texts, words, keys, id_column, hot_rows)


def _listed_hits(texts: DataFrame, words: DataFrame, keys: Sequence[str], id_column: str, hot_rows: int) -> DataFrame:
    """The words of each text, found in the task that has the text; the list of words goes round."""
    listed = words.groupBy(*keys).agg(F.collect_list(F.col("word").cast("binary")).alias("_words"))
    listed = _stored(listed.withColumn("_list", F.monotonically_increasing_id()), "word-lists")
    lists = words.sparkSession.sparkContext.broadcast(
        {r["_list"]: [bytes(w) for w in r["_words"]] for r in listed.select("_list", "_words").collect()}
    )
    numbers = listed.select(*keys, "_list")
    # A text without an id, like one without a key, is never found.
    asked = _dealt(texts, id_column).where(F.col(id_column).isNotNull())
    if keys:
        asked = spread_join(asked, numbers, keys, [id_column], hot_rows=hot_rows)
    else:
        asked = asked.withColumn("_list", F.lit(numbers.first()["_list"]))
    fields = F.transform("fields", lambda f: f.cast("binary")).alias("fields")
    asked = asked.select(*keys, id_column, "_list", fields)
    schema = T.StructType([*asked.select(*keys, id_column).schema.fields, T.StructField("_words", T.ArrayType(T.BinaryType()))])
    find = finder()
    found = asked.mapInArrow(lambda batches: find(batches, lists.value), schema)
    return found.select(*keys, id_column, F.explode(F.col("_words").cast("array<string>")).alias("word")).select(*keys, "word", id_column)


def _indexed_hits(texts: DataFrame, words: DataFrame, keys: Sequence[str], id_column: str, hot_rows: int) -> DataFrame:
    """``substring_hits`` for long lists of words.

    An inverted index holds, for every substring of up to three characters that some word has, the ids of the
    texts with it. A word is looked up by its two rarest substrings; the ids that both have are candidates. Only
    then are texts fetched, each once with all of its candidates, and tested. A word with a
    substring that is nowhere is done without any text.
    """
    length = F.least(F.length("word"), F.lit(GRAM))
    sizes = sorted(r[0] for r in words.select(length.alias("n")).distinct().collect())  # three numbers at most
    if not sizes:
        return texts.select(*keys, F.lit("").alias("word"), id_column).limit(0)
    own = F.coalesce(*[F.when(length == n, _grams(F.col("word"), [n])) for n in sizes])
    asked = words.select(*keys, "word", F.explode(own).alias("gram")).where(F.length("gram") == length)
    asked = _stored(asked, "asked-grams")
    needed = _listed(_stored(asked.select(*keys, "gram").distinct(), "needed-grams"))
    field = _dealt(texts, id_column).select(*keys, id_column, F.explode("fields").alias("field"))
    index = field.select(*keys, id_column, F.explode(_grams(F.col("field"), sizes)).alias("gram"))
    # Two fields of a text may give the same row twice; the set of candidates below has each once.
    index = _stored(index.join(needed, [*keys, "gram"], "left_semi"), "gram-index")

    often = index.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    # The grams of one word.
    rarest = F.array_sort(F.collect_list(F.struct("n", "gram")))
    found = asked.join(often, [*keys, "gram"], "left").groupBy(*keys, "word").agg(
        rarest.alias("grams"), F.bool_and(F.col("n").isNotNull()).alias("whole")
    )
    found = found.where("whole").select(
        *keys, "word", F.col("grams")[0]["gram"].alias("gram"), F.get(F.col("grams"), F.lit(1))["gram"].alias("second")
    )
    first = spread_join(index, _stored(found, "rarest-grams"), [*keys, "gram"], [id_column], hot_rows=hot_rows)
    first = first.select(*keys, "word", "second", id_column)
    both = first.where("second IS NOT NULL").join(
        index.withColumnRenamed("gram", "second"), [*keys, "second", id_column], "left_semi"
    )
    alone = first.where("second IS NULL").select(*keys, "word", id_column)
    candidates = both.select(*keys, "word", id_column).union(alone)
    tried = candidates.groupBy(*keys, id_column).agg(F.collect_set("word").alias("tried"))
    there = F.filter("tried", lambda w: F.exists("fields", lambda f: F.contains(f, w)))
    return (
        texts.join(tried, [*keys, id_column])
        .select(*keys, id_column, F.explode(there).alias("word"))
        .select(*keys, "word", id_column)
    )


def memory_search(fragments: DataFrame, queries: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fragments of the asking customer that contain the query, or all of them when none does.

    Equal questions of a customer are asked once, of an index of substrings. The hits, ids only, are stored, since
    both the answers and the list of queries without any need them. An empty question is in every
    fragment that has any text; a null one is in none.
    """
    asked = queries.select("query_id", "customer_id", F.lower("query").alias("word"))
    searched = [F.lower("summary"), F.lower("channel")]
    fields = F.array(*searched)
    if "metadata" in fragments.columns:
        values = F.transform(F.map_values("metadata"), lambda v: F.lower(v.cast("string")))
        fields = F.concat(fields, F.coalesce(values, F.array().cast("array<string>")))
    texts = fragments.select("customer_id", "fragment_id", F.array_compact(fields).alias("fields"))
    words = asked.where("word <> ''")
    hits = substring_hits(texts, words, ["customer_id"], "fragment_id", hot_rows=hot_rows)
    blank = asked.where("word = ''").select("customer_id", "word").distinct()
    any_text = texts.where(F.size("fields") > 0).select("customer_id", "fragment_id")
    everything = spread_join(any_text, blank, ["customer_id"], ["fragment_id"], hot_rows=hot_rows)
    names = ["customer_id", "word", "fragment_id"]
    hits = _stored(hits.select(*names).union(everything.select(*names)), "memory-hits")
    matched = asked.join(hits, ["customer_id", "word"])
    unanswered = asked.join(hits.select("customer_id", "word").distinct(), ["customer_id", "word"], "left_anti")
    rest = spread_join(
        fragments.select("customer_id", "fragment_id"),
        unanswered.select("query_id", "customer_id"),
        ["customer_id"],
        ["fragment_id"],
        hot_rows=hot_rows,
    )
    columns = ["query_id", "customer_id", "fragment_id"]
    return (
        matched.select(*columns)
        .withColumn("is_match", F.lit(True))
        .unionByName(rest.select(*columns).withColumn("is_match", F.lit(False)))
    )


def policy_search(policies: DataFrame, queries: DataFrame, k: int = 2, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Policies whose title or summary contains a word of the query, else the first ``k`` policies.

    Blank queries are for ``validate.blank`` to turn away beforehand. The distinct words of all queries are looked
    up once, in an index of substrings. The hits, ids and words only, are stored, since both the answers and the list
    of queries without any need them.
    """
    words = queries.select(
        "query_id",
        F.explode(F.array_distinct(F.split(strip(F.lower("query")), SPACES))).alias("word"),
    ).filter(F.col("word") != "")
    fields = F.array_compact(F.array(F.lower("title"), F.lower("summary")))
    texts = policies.select("policy_id", fields.alias("fields"))
    found = _stored(substring_hits(texts, words, [], "policy_id", hot_rows=hot_rows), "policy-hits")
    places = policies.select("policy_id", "position")
    matched = words.join(found, "word").select("query_id", "policy_id").distinct().join(places, "policy_id")
    matched = matched.select("query_id", "policy_id", "position")
    first = (
        policies.select("policy_id", "position")
        .orderBy("position")
        .limit(k)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position")))
    )
    unanswered = queries.select("query_id").join(matched.select("query_id").distinct(), "query_id", "left_anti")
    fallback = (
        unanswered.withColumn("_rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .join(F.broadcast(first), "_rank")
        .select("query_id", "policy_id", "position")
    )
    return matched.withColumn("is_match", F.lit(True)).unionByName(fallback.withColumn("is_match", F.lit(False)))


def match_rules(
    items: DataFrame,
    rules: DataFrame,
    id_column: str,
    text_column: str,
    default: str | None = None,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, label, priority, word): the first rule of a rule table that has a word in each text.

    The form of ``rules.first_match`` for tables too long for an expression. ``rules`` has ``priority``, ``label``
    and ``word``, one row for each word of a rule. The lowest priority wins, of equal ones the smallest label, then
    word. Words are looked for in the lower-cased text, as substrings; an empty word is in every text, a null word
    or priority matches nothing, a null text counts as empty. A text that no rule matches has the ``default`` label.
    Every row of ``items`` is returned; rows with the same id are one item, and all get its first rule. A null id
    gets what an empty text gets.

    All words are looked up at once, in the index of ``substring_hits``. A text's hits meet their rules where
    they are found, so that one row a text is left before the shuffle, while the rule table is short enough to
    be sent round; a longer one is joined by shuffle.
    """
    ranked = rules.where("word IS NOT NULL AND priority IS NOT NULL").groupBy("word")
    best = _stored(ranked.agg(F.min(F.struct("priority", "label")).alias("r")).select("word", "r.*"), "rules")
    everywhere = best.where("word = ''").first()  # one row for each word
    texts = items.select(id_column, F.array(F.lower(F.coalesce(text_column, F.lit("")))).alias("fields"))
    hits = substring_hits(texts, best.where("word <> ''"), [], id_column, hot_rows=hot_rows)
    if best.count() <= LISTED_ROWS:
        met = hits.join(F.broadcast(best), "word")
    else:
        met = spread_join(_stored(hits, "rule-hits"), best, ["word"], [id_column], hot_rows=hot_rows)
    order = ("priority", "label", "word")
    first = met.groupBy(id_column).agg(F.min(F.struct(*order)).alias("_hit"))
    # The aggregate has one row for each id, so large ids of the items can be spread.
    answered = spread_join(items.select(id_column), _stored(first, "first-rules"), [id_column], [id_column], "left", hot_rows=hot_rows)
    kinds = {f.name: f.dataType for f in best.schema.fields}
    if everywhere is not None:
        blank = F.struct(*[F.lit(everywhere[c]).cast(kinds[c]).alias(c) for c in order])
        answered = answered.withColumn("_hit", F.least(F.coalesce("_hit", blank), blank))
    label = F.when(F.col("_hit").isNull(), F.lit(default)).otherwise(F.col("_hit.label"))
    return answered.select(id_column, label.alias("label"), F.col("_hit.priority").alias("priority"), F.col("_hit.word").alias("word"))
