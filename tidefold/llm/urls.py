"""URL filter: host rules, and a learnt judgement of the words in hosts and paths.

A URL's runs of letters are split into words by unigram Viterbi, with costs from the words of all pages and documents, and
multinomial naive Bayes, learnt from the words of all URLs, scores the words. URLs are labelled weakly, by a fixed list of
block words. Both models are tables that stay in the cluster, whatever their size: pieces of the distinct runs meet the
costs in a join, split runs meet the odds of their words in another, and URLs meet the scores of their runs in a third.
Runs and URLs that many rows share are dealt over tasks. `UrlModel` is the same for models that fit into memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_facts, materialize, scratch, table, unused

# The rules of the query as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# Words of names that are usually blocked, and of ordinary ones; both label the URLs that train the classifier.
BLOCK_WORDS = tuple("casino poker slots bet bets betting gamble jackpot win winner lottery roulette bingo pills pill viagra cialis pharmacy meds drugs cheap free discount deal deals spam farm seo clicks click track tracker tracking ads ad adserver popup banner porn xxx sex adult cam cams escort dating nude loan loans payday credit cash money bitcoin crypto forex replica warez crack keygen torrent hack cheats bonus promo offer prize".split())
ALLOW_WORDS = tuple("www blog news docs doc wiki help support home about page pages article articles post posts archive index shop store mail forum community library science school university research health weather sports travel music art book books history world city local people food recipes garden photo video games software code data open source project tech review reviews guide map maps job jobs events contact team press media today daily times journal review radio family kids house green blue river mountain the and of for my our your best top new all one".split())

_CUT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"(\d+)")

#: Letters of a word that the costs know, at most.
LONGEST = 40


def viterbi(token: str, cost: dict[str, float], unknown: float, longest: int = LONGEST) -> tuple[str, ...]:
    """The cheapest split of a token into words, longer last words first at a tie; letters outside every word are joined into unknown pieces."""
    best, back = [0.0] + [math.inf] * len(token), [0] * (len(token) + 1)
    for end in range(1, len(token) + 1):
        for start in range(max(0, end - longest), end):
            c = cost.get(token[start:end], unknown if end - start == 1 else math.inf)
            if best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    pieces, end = [], len(token)
    while end:
        pieces.append(token[back[end] : end])
        end = back[end]
    out: list[str] = []
    loose = ""
    for p in reversed(pieces):
        if p in cost:
            out += [loose, p] if loose else [p]
            loose = ""
        else:
            loose += p
    return tuple(out + [loose] if loose else out)


class UrlModel:
    """Unigram word costs for the Viterbi split, and log odds of block against allow for each word."""

    def __init__(self, block_words=BLOCK_WORDS, allow_words=ALLOW_WORDS, prior_block: float = 0.2, threshold: float = 0.5, alpha: float = 0.1):
        self.block_words, self.allow_words = frozenset(block_words), frozenset(allow_words)
        self.listed = Counter(block_words), Counter(allow_words)
        self.prior = math.log(prior_block / (1 - prior_block))
        self.threshold, self.alpha = threshold, alpha
        lists = self.listed[0] + self.listed[1]
        self.learn_costs(lists, sum(lists.values()))
        self.learn_odds({}, {})

    def learn_costs(self, counts: dict[str, float], total: float) -> None:
        """Costs of words from their counts among `total`."""
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) > 1}
        self.unknown = math.log(total) + 2.0  # a letter that no word covers
        self.longest = max(map(len, counts))
        self.known: dict[str, tuple[str, ...]] = {}

    def learn_odds(self, block: dict[str, int], allow: dict[str, int], totals: tuple[int, int] = (0, 0)) -> None:
        """Log odds of words from their counts in the URLs of each class; each seed list counts as one more URL of its class."""
        b, a = (listed + Counter(counts) for listed, counts in zip(self.listed, (block, allow)))
        n_b, n_a = (sum(listed.values()) + n for listed, n in zip(self.listed, totals))
        vocabulary = sorted(set(b) | set(a))
        size = self.alpha * (len(vocabulary) + 1)
        self.odds = {w: math.log((b[w] + self.alpha) / (n_b + size)) - math.log((a[w] + self.alpha) / (n_a + size)) for w in vocabulary}

    def label(self, words: list[str]) -> str:
        """The weak label of a URL's words: a URL without a block word counts as allow, so that words common to both say nothing."""
        return "allow" if self.block_words.isdisjoint(words) else "block"

    def split(self, token: str) -> tuple[str, ...]:
        if token not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[token] = viterbi(token, self.cost, self.unknown, self.longest)
        return self.known[token]

    def words(self, text: str) -> list[str]:
        return [w for run in _CUT.split(text.lower()) for token in _DIGITS.split(run) if token and not token.isdigit() for w in self.split(token)]

    def score(self, host: str, path: str) -> float:
        """Probability of block; words that the model doesn't know say nothing."""
        odds = self.prior + sum(self.odds.get(w, 0.0) for w in self.words(host) + self.words(path))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or its subdomains and the start of the path: its text and its verdict, or null."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Words (two to 40 letters a to z) of all pages' texts and all documents, and how often each occurs.

    Host names aren't counted: their run-together words would be words of their own.
    """
    page = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    texts = pages.select(page.alias("t")).unionByName(documents.select(F.col("text").alias("t")))
    words = texts.select(F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).alias("word")).where(F.col("word").rlike("^[a-z]{2,40}$"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _costs(pages: DataFrame, documents: DataFrame, listed: frozenset[str]) -> tuple[DataFrame, float]:
    """Words with their costs, and that of a letter that no word covers; a listed word is as frequent as the mean word at least."""
    counts = materialize(word_counts(pages, documents), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = max(1.0, total / max(distinct, 1))
    whole = total + mean * len(listed)
    named = counts.sparkSession.createDataFrame([(w, mean) for w in sorted(listed)], "word string, least double")
    both = counts.join(named, "word", "full").select("word", F.greatest(F.coalesce(F.col("n").cast("double"), F.lit(0.0)), F.coalesce("least", F.lit(0.0))).alias("n"))
    costs = materialize(both.where(F.length("word") > 1).select("word", (-F.log(F.col("n") / whole)).alias("cost")), "costs")
    discard(counts)
    return costs, math.log(whole) + 2.0


def split_tokens(tokens: DataFrame, costs: DataFrame, unknown: float) -> DataFrame:
    """Distinct `token`s, runs of letters a to z, with their `pieces`: each meets those of its pieces that are words, and no others."""
    raw = F.encode("token", "UTF-8")  # a piece of bytes is taken without going through what is before it
    cut = lambda b: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))), lambda i: F.transform(F.filter(F.sequence(F.lit(2), F.lit(LONGEST)), lambda k: k <= F.length(b) - i + 1), lambda k: b.substr(i, k).cast("string"))))
    pieces = tokens.select("token", F.explode(F.array_distinct(F.get(F.transform(F.array(raw), cut), 0))).alias("word"))
    met = pieces.join(costs, "word").groupBy("token").agg(F.collect_list(F.struct("word", "cost")).alias("words"))  # of one token

    def run(batches):
        for pdf in batches:
            found = [viterbi(t, {w["word"]: w["cost"] for w in ws} if ws is not None else {}, unknown) for t, ws in zip(pdf["token"], pdf["words"])]
            yield pd.DataFrame({"token": pdf["token"], "pieces": [list(f) for f in found]})

    return tokens.select("token").join(met, "token", "left").mapInPandas(run, "token string, pieces array<string>")


def score_urls(urls: DataFrame, pages: DataFrame, documents: DataFrame, url: str = "url", **options) -> DataFrame:
    """The probability of block for each distinct URL of `urls` (host, path), (host, path, n, score), learnt from `pages` (url, html)
    and `documents` (text); `n` counts its rows, `options` are those of `UrlModel`.

    Counts and costs are of all rows. Null URLs and texts count as empty; without pages or documents the lists alone are
    the model. A URL is read whole, however long; no URLs give no rows.
    """
    model = UrlModel(**options)
    listed = model.block_words | model.allow_words
    costs, unknown = _costs(pages, documents, listed)
    host, path = parts(F.col(url))
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("[a-z]+"), F.lit(0))
    both = urls.select("host", "path", F.lit(1).alias("asked"), F.lit(0).alias("taught")).unionByName(pages.select(host.alias("host"), path.alias("path"), F.lit(0).alias("asked"), F.lit(1).alias("taught")))
    named = materialize(both.groupBy("host", "path").agg(F.sum("asked").alias("asked"), F.sum("taught").alias("taught")).withColumn("runs", runs), "urls")
    met = named.select("host", "path", "asked", "taught", F.explode("runs").alias("token"))
    tokens = materialize(met.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    split = materialize(split_tokens(tokens, costs, unknown), "split")
    # a URL's label: whether one of its words is a block word
    bad = F.exists("pieces", lambda p: p.isin(*sorted(model.block_words)))
    facts = materialize(tokens.join(split.select("token", bad.alias("bad")), "token"), "labels")
    count = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labelled = join_facts(met.where("taught > 0").select("host", "path", "taught", "token"), facts, ["token"], count)
    labelled = labelled.groupBy("host", "path").agg(F.max("taught").alias("taught"), F.bool_or("bad").alias("bad"), F.collect_list("token").alias("tokens"))  # of one URL
    taught = labelled.select("taught", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("taught")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("taught"))).alias("a"))
    words = taught.join(split, "token").select("b", "a", F.explode("pieces").alias("word"))
    lists = urls.sparkSession.createDataFrame([(w, n, 0) for w, n in sorted(model.listed[0].items())] + [(w, 0, n) for w, n in sorted(model.listed[1].items())], "word string, b long, a long")
    words = materialize(words.unionByName(lists.select("b", "a", "word")).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "odds")
    n_b, n_a, size = words.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    alpha, smooth = model.alpha, model.alpha * (size + 1)
    odds = words.select("word", (F.log((F.col("b") + alpha) / (n_b + smooth)) - F.log((F.col("a") + alpha) / (n_a + smooth))).alias("odds"))
    scored = split.select("token", F.explode("pieces").alias("word")).join(odds, "word").groupBy("token").agg(F.sum("odds").alias("odds"))
    facts = materialize(tokens.join(scored, "token", "left").select("token", "n", F.coalesce("odds", F.lit(0.0)).alias("odds")), "scores")
    found = join_facts(met.where("asked > 0").select("host", "path", "token"), facts, ["token"], count).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    total = F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), total))))
    return named.where("asked > 0").join(found, ["host", "path"], "left").select("host", "path", F.col("asked").alias("n"), score.alias("score"))


def learn_and_judge(pages: DataFrame, documents: DataFrame, learn_from: DataFrame | None = None, url: str = "url", rules=RULES, **options) -> DataFrame:
    """`judge` by a model learnt from all of `learn_from` (the pages themselves, if none are given) and all documents."""
    spark, model = pages.sparkSession, UrlModel(**options)
    with scratch(spark):
        host, path = parts(F.col(url))
        names = {c: unused(pages, c) for c in ("host", "path", "rule", "says", "score", "verdict")}
        split = pages.withColumns({names["host"]: host, names["path"]: path})
        scores = materialize(score_urls(split.select(F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path")), pages if learn_from is None else learn_from, documents, url, **options), "judged")
        facts = scores.select(F.col("host").alias(names["host"]), F.col("path").alias(names["path"]), "n", F.col("score").alias(names["score"]))
        rows = split.select(F.struct(*pages.columns).alias("__row"), names["host"], names["path"])  # so that no column is called as those of the join
        rows = join_facts(rows, facts, [names["host"], names["path"]], pages.count()).select("__row.*", *[names[c] for c in ("host", "path", "score")])
        return materialize(_verdicts(rows, pages, names, rules, model.threshold), "verdicts", keep=True)


def _verdicts(scored: DataFrame, pages: DataFrame, names: dict, rules, threshold: float) -> DataFrame:
    rule, says = with_rules(F.col(names["host"]), F.col(names["path"]), rules)
    made = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in made]
    ruled = scored.withColumns({names["rule"]: rule, names["says"]: says})
    verdict = F.coalesce(F.col(names["says"]), F.when(F.col(names["score"]) >= threshold, "block").otherwise("allow"))
    return ruled.withColumn(names["verdict"], verdict).select(*kept, *[F.col(names[c]).alias(c) for c in made])


def judge(pages: DataFrame, url: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """Add host, path, rule, score (probability of block) and verdict (the rule's, else block from `threshold` on).

    A null URL, an empty one or one without ``://`` has empty parts, no rule and the model's prior as its score. A URL is
    judged whole, however long. Repeated rows are judged each; of rules of one length the later in order wins; an empty
    table stays empty; existing columns of the added names are replaced, others stay.
    """
    model = model or UrlModel()

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([model.score(h, p) for h, p in zip(host, path)], dtype="float64")

    host, path = parts(F.col(url))
    names = {c: unused(pages, c) for c in ("host", "path", "rule", "says", "score", "verdict")}
    split = pages.withColumns({names["host"]: host, names["path"]: path})
    return _verdicts(split.withColumn(names["score"], score(names["host"], names["path"])), pages, names, rules, model.threshold)


def query(spark, sf_dir: str) -> DataFrame:
    """`op3_url_filter`: every page's URL judged."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = learn_and_judge(pages.select("page_id", "url"), table(spark, sf_dir, "documents").select("text"), learn_from=pages)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
