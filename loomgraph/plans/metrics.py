"""Queries on metrics, losses and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import textmetrics as tm
from loomgraph.functions.text import SPACE, nfc_col
from loomgraph.operators import metrics as mt
from loomgraph.operators import questions as qs
from loomgraph.plans import questions as qs_plans
from loomgraph.plans.base import Book
from loomgraph.session import table

book = Book()


@book.add("metric_hits_by_status", "SELECT o_orderstatus, count(*) AS n, round(avg(CASE WHEN 1 + o_custkey % 12 <= 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN 1 + o_custkey % 12 <= 3 THEN 1.0 ELSE 0 END), 4) AS hit3, round(avg(CASE WHEN 1 + o_custkey % 12 <= 10 THEN 1.0 ELSE 0 END), 4) AS hit10, round(avg(1.0 / (1 + o_custkey % 12)), 4) AS mrr FROM orders GROUP BY 1")
def _(spark, d):
    return mt.hits(table(spark, d, "orders").withColumn("rank", 1 + F.col("o_custkey") % 12), "rank", "o_orderstatus")


@book.add("metric_latency", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def _(spark, d):
    return mt.latency(table(spark, d, "events"), "value")


@book.add("metric_kappa", """WITH g AS (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN 1.0 ELSE 0 END AS a, CASE WHEN l_partkey % 4 <> 0 THEN 1.0 ELSE 0 END AS b FROM lineitem), s AS (SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(a) AS pa, avg(b) AS pb, count(*) AS n FROM g)
    SELECT round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa, round(100 * po, 2) AS agreement, round(100 * pa, 2) AS pass_a, round(100 * pb, 2) AS pass_b, n FROM s""")
def _(spark, d):
    return mt.kappa(table(spark, d, "lineitem"), (F.col("l_orderkey") % 3 != 0).cast("int"), (F.col("l_partkey") % 4 != 0).cast("int"))


@book.add("metric_sheet_complete", "SELECT CAST(sum(CASE WHEN tau_start IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tau_start, CAST(sum(CASE WHEN answer_label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS answer_label FROM questions")
def _(spark, d):
    return mt.complete(table(spark, d, "questions"), ["tau_start", "answer_label"])


@book.add("metric_sheets_aligned", "SELECT count(*) AS n, CAST(sum(CASE WHEN a.question = b.question THEN 1 ELSE 0 END) AS BIGINT) AS same FROM showcase_samples a JOIN questions b USING (qid)")
def _(spark, d):
    a, b = table(spark, d, "showcase_samples").select("qid", "question"), table(spark, d, "questions").select("qid", F.col("question").alias("other"))
    return a.join(b, "qid").agg(F.count("*").alias("n"), F.sum((F.col("question") == F.col("other")).cast("int")).alias("same"))


#: Runs made of orders: a history row per order of a customer.
HIST_SQL = "hist AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, CAST(o_orderkey * 37 % 101 AS DOUBLE) / 101 AS mrr FROM orders)"


def history(spark, d):
    from pyspark.sql import Window as W

    e = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), e.alias("epoch"), (F.pmod(F.col("o_orderkey") * 37, F.lit(101)).cast("double") / 101).alias("mrr"))


@book.add("run_best_epoch", f"WITH {HIST_SQL} SELECT run, epoch, round(mrr, 6) AS mrr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY mrr DESC, epoch) AS rn FROM hist) WHERE rn = 1")
def _(spark, d):
    return mt.best_by(history(spark, d), ["run"], "mrr", "epoch").select("run", "epoch", F.round("mrr", 6).alias("mrr"))


@book.add("run_best_alpha", "WITH f AS (SELECT 'train_results_alpha_' || (o_custkey % 5) AS file, max(CAST(o_orderkey * 13 % 89 AS DOUBLE)) AS mrr FROM orders GROUP BY 1) SELECT file, mrr FROM f ORDER BY mrr DESC, file LIMIT 1")
def _(spark, d):
    f = table(spark, d, "orders").groupBy(F.concat(F.lit("train_results_alpha_"), (F.col("o_custkey") % 5).cast("string")).alias("file")).agg(F.max(F.pmod(F.col("o_orderkey") * 13, F.lit(89)).cast("double")).alias("mrr"))
    return mt.best_by(f, [], "mrr", "file")


@book.add("run_best_seed", f"WITH {HIST_SQL}, s AS (SELECT run % 7 AS tag, run, max(mrr) AS mrr FROM hist GROUP BY 1, 2) SELECT tag, run AS seed, round(mrr, 6) AS mrr FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY mrr DESC, run) AS rn FROM s) WHERE rn = 1")
def _(spark, d):
    s = history(spark, d).groupBy((F.col("run") % 7).alias("tag"), F.col("run").alias("seed")).agg(F.max("mrr").alias("mrr"))
    return mt.best_by(s, ["tag"], "mrr", "seed").select("tag", "seed", F.round("mrr", 6).alias("mrr"))


@book.add("run_early_stop", f"""WITH {HIST_SQL}, b AS (SELECT *, max(mrr) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hist), i AS (SELECT *, before IS NULL OR mrr > before AS improved FROM b), w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM i),
    s AS (SELECT *, min(CASE WHEN waited >= 3 THEN epoch END) OVER (PARTITION BY run) AS stops FROM w) SELECT run, epoch, improved, CAST(waited AS INTEGER) AS waited, coalesce(epoch = stops, false) AS stop, coalesce(epoch <= stops, true) AS trained FROM s""")
def _(spark, d):
    return mt.early_stop(history(spark, d), 3).select("run", "epoch", "improved", "waited", "stop", "trained")


STEP_SQL = "st AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS step, CASE WHEN l_orderkey % 17 = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS loss FROM lineitem)"


def steps(spark, d):
    from pyspark.sql import Window as W

    e = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), e.alias("step"), F.when(F.col("l_orderkey") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("loss"))


@book.add("run_nan_guard", f"WITH {STEP_SQL}, c AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN isnan(loss) THEN 1 ELSE 0 END) OVER w AS bad FROM st WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT run, step, n AS seen, CAST(bad AS BIGINT) AS n_nan, n >= 20 AND bad / n > 0.05 AS abort FROM c")
def _(spark, d):
    return mt.nan_guard(steps(spark, d))


@book.add("run_loss_trend", f"WITH {STEP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b, CASE WHEN NOT isnan(loss) THEN loss END AS ok FROM st) SELECT run, round(avg(CASE WHEN a <= 10 THEN ok END), 6) AS first_mean, round(avg(CASE WHEN b <= 10 THEN ok END), 6) AS last_mean, avg(CASE WHEN b <= 10 THEN ok END) < avg(CASE WHEN a <= 10 THEN ok END) AS falls, CAST(sum(CASE WHEN isnan(loss) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan FROM r GROUP BY run")
def _(spark, d):
    return mt.loss_trend(steps(spark, d))


@book.add("run_status", """WITH e AS (SELECT n_name AS tag, s AS seed FROM nation, (VALUES (42), (43), (44)) v(s)), r AS (SELECT n_name AS tag, 42 AS seed, n_nationkey % 2 = 0 AS converged FROM nation WHERE n_nationkey % 3 <> 0), c AS (SELECT n_name AS tag, 43 AS seed FROM nation WHERE n_nationkey % 4 = 0)
    SELECT e.tag, e.seed, CASE WHEN r.tag IS NOT NULL AND coalesce(r.converged, false) THEN 'completed' WHEN r.tag IS NOT NULL OR c.tag IS NOT NULL THEN 'in_progress_interrupted' ELSE 'not_started' END AS status FROM e LEFT JOIN r USING (tag, seed) LEFT JOIN c USING (tag, seed)""")
def _(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_name").alias("tag"), F.explode(F.array(F.lit(42), F.lit(43), F.lit(44))).alias("seed"))
    r = n.where("n_nationkey % 3 <> 0").selectExpr("n_name as tag", "42 as seed", "n_nationkey % 2 = 0 as converged")
    return mt.run_status(e, r, n.where("n_nationkey % 4 = 0").selectExpr("n_name as tag", "43 as seed"))


@book.add("run_missing_list", """WITH e AS (SELECT n_name AS tag, n_nationkey AS k FROM nation) SELECT 'missing: ' || string_agg(tag, ', ' ORDER BY tag) AS missing, count(*) > 0 AS provisional, count(*) AS n FROM e WHERE k % 3 = 0""")
def _(spark, d):
    m = table(spark, d, "nation").where("n_nationkey % 3 = 0")
    return m.agg(F.concat(F.lit("missing: "), F.array_join(F.sort_array(F.collect_list("n_name")), ", ")).alias("missing"), (F.count("*") > 0).alias("provisional"), F.count("*").alias("n"))


@book.add("run_scenarios", "SELECT p_name AS scenario, row_number() OVER (ORDER BY p_size, p_partkey) AS pos FROM part")
def _(spark, d):
    from loomgraph.operators.ranking import running_position

    return running_position(table(spark, d, "part").select("p_partkey", "p_size", F.col("p_name").alias("scenario")), [], ["p_size", "p_partkey"], rank_col="pos").select("scenario", "pos")


_POISSON = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in mt.POISSON)


@book.add("metric_bootstrap", f"""WITH d AS (SELECT s_suppkey AS i, 1.0::DOUBLE / (1 + s_suppkey % 7) - 1.0::DOUBLE / (1 + s_suppkey % 5) AS d FROM supplier), n AS (SELECT avg(d) AS obs FROM d),
    dr AS (SELECT rep, d, ('0x' || substring(md5('0|' || rep || '|' || i), 1, 12))::BIGINT AS u FROM d, (SELECT unnest(range(1000)) AS rep)), m AS (SELECT rep, sum(w * d) / sum(w) AS m FROM (SELECT rep, d, {_POISSON} AS w FROM dr) GROUP BY rep)
    SELECT round(any_value(obs), 6) AS observed, round(avg(CASE WHEN round(abs(m), 9) >= round(abs(obs), 9) THEN 1.0 ELSE 0 END), 6) AS p FROM m, n""")
def _(spark, d):
    return mt.bootstrap(table(spark, d, "supplier").selectExpr("s_suppkey as i", "1 + s_suppkey % 7 as rank_a", "1 + s_suppkey % 5 as rank_b"))


@book.add("loss_qa", "SELECT round(avg(-ln(greatest(CAST(l_discount AS DOUBLE) * 5, 1e-12))), 6) AS loss FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.round(mt.qa_loss(F.col("l_discount").cast("double") * 5), 6).alias("loss"))


@book.add("loss_margin", "SELECT round(avg(greatest(0.0, 1.0 + l_tax * 10 - l_discount * 10)), 6) AS loss FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.round(mt.margin_loss(F.col("l_tax") * 10, F.col("l_discount") * 10), 6).alias("loss"))


_P = "least(greatest(CAST(l_discount AS DOUBLE) * 9, 1e-6), 1 - 1e-6)"


@book.add("loss_masked_bce", f"SELECT l_returnflag, round(coalesce(avg(CASE WHEN l_linenumber % 2 = 0 THEN -((l_orderkey % 2) * ln({_P}) + (1 - l_orderkey % 2) * ln(1 - {_P})) END), 0), 6) AS loss FROM lineitem GROUP BY 1")
def _(spark, d):
    t = (F.col("l_orderkey") % 2).cast("double")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(mt.masked_bce(F.col("l_discount").cast("double") * 9, t, F.col("l_linenumber") % 2 == 0), 6).alias("loss"))


@book.add("loss_total", "SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE * l_quantity + 0.5::DOUBLE * l_tax + 0.3::DOUBLE * l_discount, 6) AS loss FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(mt.total_loss(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")), 6).alias("loss"))


@book.add("loss_negatives", """WITH e AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM questions WHERE t IS NOT NULL)), q AS (SELECT qid, t, ('0x' || substring(md5('neg|' || qid), 1, 12))::BIGINT AS dr FROM questions)
    SELECT q.qid, CASE WHEN a.t = q.t THEN b.t ELSE a.t END AS t_neg FROM q JOIN e a ON a.k = q.dr % a.n JOIN e b ON b.k = (q.dr + 1) % b.n""")
def _(spark, d):
    from loomgraph.operators.ranking import running_position

    q = table(spark, d, "questions").select("qid", "t")
    e = running_position(q.where("t is not null").select("t").distinct(), [], ["t"], rank_col="k").withColumn("k", F.col("k") - 1)
    n = e.count()
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("neg|"), "qid")), 1, 12), 16, 10).cast("long")
    q = q.withColumn("dr", draw).withColumn("ka", F.pmod("dr", F.lit(n))).withColumn("kb", F.pmod(F.col("dr") + 1, F.lit(n)))
    a, b = e.select(F.col("k").alias("ka"), F.col("t").alias("ta")), e.select(F.col("k").alias("kb"), F.col("t").alias("tb"))
    return q.join(a, "ka").join(b, "kb").select("qid", F.when(F.col("ta") == F.col("t"), F.col("tb")).otherwise(F.col("ta")).alias("t_neg"))


@book.add("rank_in_list", "SELECT l_orderkey, l_linenumber, coalesce(list_position([1, 3, 5, 7], l_linenumber), 5) AS rank FROM lineitem")
def _(spark, d):
    lst = F.array(*[F.lit(x) for x in (1, 3, 5, 7)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mt.list_rank(lst, F.col("l_linenumber")).alias("rank"))


@book.add("text_word_count", f"SELECT doc_id, len(list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", f"{SPACE}+"), lambda x: x != "")).alias("n"))


@book.add("text_normalise", rf"SELECT qid, regexp_replace(regexp_replace(trim(lower(nfc_normalize(answer_label))), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g') AS norm FROM questions")
def _(spark, d):
    q = table(spark, d, "questions")
    x = F.regexp_replace(F.trim(F.lower(nfc_col(F.col("answer_label")))), r"[^\p{L}\p{N}_\s]", "")
    return q.select("qid", F.regexp_replace(x, r"\s+", " ").alias("norm"))


@book.add("text_free_hit", "SELECT round(avg(CASE WHEN lower(trim(answer)) = lower(trim(fact_6tuple.t_label)) THEN 1.0 ELSE 0 END), 6) AS hit1 FROM showcase_samples")
def _(spark, d):
    return table(spark, d, "showcase_samples").agg(F.round(F.avg(F.coalesce(F.lower(F.trim("answer")) == F.lower(F.trim("fact_6tuple.t_label")), F.lit(False)).cast("double")), 6).alias("hit1"))


def _tok13(c: str) -> str:
    """Evaluation tokens of a text, see textmetrics.tokens_13a."""
    for pattern, put in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'gs')"
    return f"list_filter(string_split_regex({c}, '{SPACE}+'), lambda x: x <> '')"


def _ngrams(c: str, n: int) -> str:
    return f"list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n} - 1], ' '))"


def _order(n: int) -> str:
    """Columns of order n: grams of the hypothesis and how many of them the reference has, each as often as there."""
    return f"len(h{n}) AS t{n}, coalesce(list_sum(list_transform(list_distinct(h{n}), lambda g: least(len(list_filter(h{n}, lambda x: x = g)), len(list_filter(r{n}, lambda x: x = g))))), 0) AS m{n}"


def _log(n: int) -> str:
    """Log precision of order n; the k-th order without a match counts 1 / 2^k matches."""
    empty = " + ".join(f"(CASE WHEN t{k} > 0 AND m{k} = 0 THEN 1 ELSE 0 END)" for k in range(1, n + 1))
    return f"CASE WHEN t{n} = 0 THEN 0 WHEN m{n} > 0 THEN ln(100.0::DOUBLE * m{n} / t{n}) ELSE ln(100.0::DOUBLE / (pow(2, {empty}) * t{n})) END"


_SETS = ", ".join(f"{_ngrams('h', n)} AS h{n}, {_ngrams('r', n)} AS r{n}" for n in range(1, 5))
#: The longest common subsequence row by row: every cell is the running maximum of "as above" and "above left plus one where the words agree".
FIDELITY_SQL = f"""{qs_plans.TPL_SQL}, txt AS (SELECT qid, q.relation, question AS hyp, replace(replace(CASE WHEN contains(pattern, '{{year}}') THEN replace(pattern, '{{year}}', CAST(tau_start AS VARCHAR)) ELSE pattern END, '{{h}}', 'X'), '{{t}}', 'X') AS ref FROM questions q JOIN tpl USING (template_id)),
    tk AS (SELECT qid, relation, hyp IS NULL OR ref IS NULL AS none, {_tok13('hyp')} AS h, {_tok13('ref')} AS r FROM txt), ng AS (SELECT *, {_SETS} FROM tk), ct AS (SELECT qid, relation, none, len(h) AS lh, len(r) AS lr, {', '.join(map(_order, range(1, 5)))} FROM ng),
    bl AS (SELECT qid, relation, CASE WHEN none THEN NULL WHEN lh = 0 OR lr = 0 OR m1 = 0 THEN 0.0 ELSE (CASE WHEN lh >= lr THEN 1.0::DOUBLE ELSE exp(1 - lr::DOUBLE / lh) END) * exp(({' + '.join(map(_log, range(1, 5)))}) / least(lh, 4)) END AS bleu FROM ct),
    wd AS (SELECT qid, regexp_extract_all(lower(ref), '[a-z0-9]+') AS a, regexp_extract_all(lower(hyp), '[a-z0-9]+') AS b FROM txt WHERE hyp IS NOT NULL AND ref IS NOT NULL),
    dp AS (SELECT w.qid, w.a, w.b, 0 AS i, list_transform(range(len(b) + 1), lambda j: 0) AS row FROM wd w),
    lcs(qid, a, b, i, row) AS (SELECT * FROM dp UNION ALL SELECT qid, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN row[k - 1] + 1 ELSE row[k] END))) FROM lcs WHERE i < len(a)),
    rg AS (SELECT qid, CASE WHEN len(a) = 0 OR len(b) = 0 OR list_max(row) = 0 THEN 0.0 ELSE 2.0::DOUBLE * (list_max(row)::DOUBLE / len(b)) * (list_max(row)::DOUBLE / len(a)) / (list_max(row)::DOUBLE / len(b) + list_max(row)::DOUBLE / len(a)) END AS rouge_l FROM lcs WHERE i = len(a)),
    fid AS (SELECT qid, relation, bleu, rouge_l FROM bl LEFT JOIN rg USING (qid))"""


def fidelity(spark, d):
    q = table(spark, d, "questions").join(F.broadcast(qs.template_table(spark).select("template_id", "pattern")), "template_id")  # twelve rows
    canon = qs.fill(F.col("pattern"), F.lit("X"), F.lit("X"), F.col("tau_start"))
    return q.select("qid", "relation", tm.bleu_col(F.col("question"), canon).alias("bleu"), tm.rouge_col(F.col("question"), canon).alias("rouge_l"))


@book.add("text_template_fidelity", f"WITH RECURSIVE {FIDELITY_SQL} SELECT qid, relation, round(bleu, 6) AS bleu, round(rouge_l, 6) AS rouge_l FROM fid")
def _(spark, d):
    return fidelity(spark, d).select("qid", "relation", F.round("bleu", 6).alias("bleu"), F.round("rouge_l", 6).alias("rouge_l"))


@book.add("text_fidelity_by_relation", f"WITH RECURSIVE {FIDELITY_SQL} SELECT relation, count(*) AS n, round(avg(bleu), 3) AS bleu, round(avg(rouge_l), 3) AS rouge_l FROM fid GROUP BY ROLLUP (relation)")
def _(spark, d):
    return fidelity(spark, d).rollup("relation").agg(F.count("*").alias("n"), F.round(F.avg("bleu"), 3).alias("bleu"), F.round(F.avg("rouge_l"), 3).alias("rouge_l"))
