"""Queries over official documents, invoices, files and batches composed from the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import batches as B
from docmill.operators import invoices as I
from docmill.operators import official as G
from docmill.operators import paragraphs as P
from docmill.plans.common import Queries, table
from docmill.plans.markdown_queries import cat
from docmill.sources import files as S
from docmill.storage import delete, materialise, shared_path

query = Queries()
QUERIES, ORACLES = query.QUERIES, query.ORACLES


def classified(spark, sf_dir):
    """Every order's paragraphs with their element; every third order lacks its signature, every fourth its date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy年M月d日").alias("d"), (F.col("o_orderkey") % 12).alias("k"))
    p = lambda n, e, t: F.struct(F.lit(n).alias("para_no"), F.lit(e).alias("element"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    key = F.col("o_orderkey").cast("string")
    paras = [
        p(0, "copy_id", ""), p(1, "copy_id", key), p(2, "title", "关于"), p(3, "title_following", cat(key, "的通知 ")), p(4, "recipient", cat("客户", F.col("o_custkey").cast("string"), "：")), p(5, "body", "文"),
        p(6, "attachment", "附件：1. 甲。"), p(7, "attachment_following", "2．乙"), p(8, "signer", "签发人： 王"), p(9, "copy_to", "抄送：A，B、 C。"), p(10, "notes", "（ok)"), p(11, "printing_date", cat(F.col("d"), "印发")),
    ]
    more = F.concat(
        F.array(*paras), F.when(F.col("k") % 3 != 0, F.array(p(12, "issuing_authority_signature", F.col("o_orderpriority")))).otherwise(F.array().cast("array<struct<para_no:int,element:string,text:string>>")),
        F.when(F.col("k") % 4 != 0, F.array(p(13, "issue_date", F.col("d")))).otherwise(F.array().cast("array<struct<para_no:int,element:string,text:string>>")),
    )
    return o.select("o_orderkey", F.explode(more).alias("p")).select("o_orderkey", "p.*")


@query(
    """SELECT o_orderkey, '关于' || o_orderkey || '的通知' AS title, ['关于' || o_orderkey || '的通知'] AS aliases, o_orderkey::VARCHAR AS copy_id, '客户' || o_custkey AS recipient, ['甲', '乙'] AS attachments, ['王'] AS signers, ['A', 'B', 'C'] AS copies,
  'ok' AS notes, strftime(o_orderdate, '%Y-%m-%d') AS printed, CASE WHEN o_orderkey % 12 % 3 <> 0 THEN o_orderpriority ELSE '' END AS signature, CASE WHEN o_orderkey % 12 % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS issued FROM orders"""
)
def G3_official_fields(spark, sf_dir):
    found = G.official_fields(classified(spark, sf_dir), ["o_orderkey"])
    names = {"标题": "title", "aliases": "aliases", "份号": "copy_id", "主送机关": "recipient", "附件说明": "attachments", "签发人": "signers", "抄送机关": "copies", "附注": "notes", "印发日期": "printed", "发文机关署名": "signature", "成文日期": "issued"}
    return found.select("o_orderkey", *(F.col(a).alias(b) for a, b in names.items()))


def raw_paragraphs(spark, sf_dir):
    """Every order as an official document of 22 paragraphs, some of them empty: each third lacks its signature, each fourth its date, each fifth has number and signer in one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy年M月d日").alias("d"), F.col("o_orderpriority").alias("clerk"), (F.col("o_orderkey") % 60).alias("k"))
    key, k = F.col("o_orderkey").cast("string"), F.col("k")
    number, shared = cat("某政发〔2024〕", key, "号"), k % 5 == 0
    texts = [
        key, "机密★1年", "特 急", "某市人民政府", F.when(shared, cat(number, "　签发人：王小")).otherwise(number), F.when(shared, "某政办〔2024〕2号　李四").otherwise("签发人：王小"),
        cat("关于", key, "的通知"), "补充 说明事项", "各市、委员会：", cat("为做好工作，", F.col("clerk")), "", "附件：1. 甲", "2．乙", F.when(k % 3 != 0, "某市财政局").otherwise(""), F.when(k % 4 != 0, F.col("d")).otherwise(""),
        "（联系人：李）", "公开方式：主动公开", "抄送：A，B", "某市办公室", cat(F.col("d"), "印发"), "附表", "",
    ]
    para = F.posexplode(F.array(*(t if not isinstance(t, str) else F.lit(t) for t in texts))).alias("para_no", "text")
    title = F.col("para_no").isin(6, 7)
    return o.select("o_orderkey", "k", para).select(
        "o_orderkey", "para_no", "text", F.when(title, "方正小标宋简体").otherwise("仿宋").alias("font"), F.when(title, 44.0).otherwise(32.0).alias("size"), ((F.col("text") == "") & (F.col("k") % 2 == 0)).alias("has_image")
    )


@query(
    """SELECT o_orderkey, p.n::INTEGER AS para_no, p.n = 0 AS digits, p.n = 4 AND o_orderkey % 60 % 5 <> 0 AS number, p.n = 4 AND o_orderkey % 60 % 5 = 0 AS number_and_signer, p.n = 5 AND o_orderkey % 60 % 5 = 0 AS number_and_name,
  p.n IN (6, 7) AS title_font, p.n IN (6, 7) AS title_size, p.n = 6 AS title_shape, p.n IN (3, 18) OR (p.n = 13 AND o_orderkey % 60 % 3 <> 0) AS authority_at_end, p.n = 14 AND o_orderkey % 60 % 4 <> 0 AS date,
  p.n = 19 OR (p.n = 14 AND o_orderkey % 60 % 4 <> 0) AS printing_date, p.n = 15 AS bracketed, p.n = 12 AS list_item, p.n = 2 AS urgency_word FROM orders, range(22) p(n)"""
)
def G1_paragraph_features(spark, sf_dir):
    shown = ("digits", "number", "number_and_signer", "number_and_name", "title_font", "title_size", "title_shape", "authority_at_end", "date", "printing_date", "bracketed", "list_item", "urgency_word")
    return P.paragraph_features(raw_paragraphs(spark, sf_dir)).select("o_orderkey", "para_no", *shown)


@query(
    """SELECT o_orderkey, p.n::INTEGER AS para_no, CASE p.n WHEN 0 THEN 'copy_id' WHEN 1 THEN 'security' WHEN 2 THEN 'urgency' WHEN 3 THEN 'issuing_authority_mark'
  WHEN 4 THEN CASE WHEN k % 5 = 0 THEN 'combined_doc_number_signer' ELSE 'doc_number' END WHEN 5 THEN CASE WHEN k % 5 = 0 THEN 'combined_doc_number_signer_following' ELSE 'signer' END
  WHEN 6 THEN 'title' WHEN 7 THEN 'title_following' WHEN 8 THEN 'recipient' WHEN 9 THEN 'body' WHEN 10 THEN CASE WHEN k % 2 = 0 THEN 'general_content' END WHEN 11 THEN 'attachment' WHEN 12 THEN 'attachment_following'
  WHEN 13 THEN CASE WHEN k % 3 <> 0 THEN 'issuing_authority_signature' WHEN k % 2 = 0 THEN 'general_content' END WHEN 14 THEN CASE WHEN k % 4 <> 0 THEN 'issue_date' ELSE 'general_content' END
  WHEN 15 THEN CASE WHEN k % 4 <> 0 THEN 'notes' END WHEN 16 THEN 'disclosure' WHEN 17 THEN 'copy_to' WHEN 18 THEN CASE WHEN k % 3 = 0 THEN 'issuing_authority_signature' ELSE 'printing_authority' END
  WHEN 19 THEN 'printing_date' WHEN 20 THEN 'attachment_content' ELSE CASE WHEN k % 2 = 0 THEN 'attachment_content' END END AS element
FROM (SELECT o_orderkey, o_orderkey % 60 AS k FROM orders), range(22) p(n)"""
)
def G2_classify_paragraphs(spark, sf_dir):
    return P.classify_paragraphs(raw_paragraphs(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "para_no", "element")


@query(
    """SELECT o_orderkey, '关于' || o_orderkey || '的通知补充 说明事项' AS title, o_orderkey::VARCHAR AS copy_id, '某政发〔2024〕' || o_orderkey || '号' AS number, '某市人民政府' AS mark, CASE WHEN k % 5 = 0 THEN ['王小', '李四'] ELSE ['王小'] END AS signers,
  CASE WHEN k % 3 <> 0 THEN '某市财政局' ELSE '某市办公室' END AS signature, CASE WHEN k % 3 <> 0 THEN '某市办公室' ELSE '' END AS printer, CASE WHEN k % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS issued,
  CASE WHEN k % 4 <> 0 THEN '联系人：李' ELSE '' END AS notes, ['甲', '乙'] AS attachments, '主动公开' AS disclosure FROM (SELECT *, o_orderkey % 60 AS k FROM orders)"""
)
def G3_fields_of_raw(spark, sf_dir):
    """From paragraphs without any classification to records."""
    found = G.official_fields(P.classify_paragraphs(raw_paragraphs(spark, sf_dir), ["o_orderkey"]), ["o_orderkey"])
    names = {"标题": "title", "份号": "copy_id", "发文字号": "number", "发文机关标志": "mark", "签发人": "signers", "发文机关署名": "signature", "印发机关": "printer", "成文日期": "issued", "附注": "notes", "附件说明": "attachments", "公开方式": "disclosure"}
    return found.select("o_orderkey", *(F.col(a).alias(b) for a, b in names.items()))


@query("SELECT o_orderkey, 'issuing_authority_signature' AS element FROM orders WHERE o_orderkey % 12 % 3 = 0 UNION ALL SELECT o_orderkey, 'issue_date' FROM orders WHERE o_orderkey % 12 % 4 = 0")
def G4_missing_elements(spark, sf_dir):
    return G.missing_elements(classified(spark, sf_dir), ["o_orderkey"])


_WRITTEN = "year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日'"


@query(f"SELECT o_orderkey, ['附件：1. 甲', '　　　2. 乙'] AS attachments, 'A，B，C' AS copies, 'ok' AS notes, {_WRITTEN} || '印发' AS printed, CASE WHEN o_orderkey % 12 % 4 <> 0 THEN {_WRITTEN} ELSE '' END AS issued FROM orders")
def G5_format_official_fields(spark, sf_dir):
    found = G.format_official_fields(G.official_fields(classified(spark, sf_dir), ["o_orderkey"]))
    names = {"附件说明": "attachments", "抄送机关": "copies", "附注": "notes", "印发日期": "printed", "成文日期": "issued"}
    return found.select("o_orderkey", *(F.col(a).alias(b) for a, b in names.items()))


@query("SELECT o_orderkey, 'n' || upper(o_orderstatus) AS a, o_orderpriority AS b FROM orders")
def U1_field_registry(spark, sf_dir):
    """Two processors in order, one of another locale and one disabled."""
    registry = G.FieldRegistry(disabled={"off"})
    registry.register("mark", lambda d: d.withColumn("a", cat("n", F.col("a"))), order=2)
    registry.register("upper", lambda d: d.withColumn("a", F.upper("a")), order=1, locales=("de_DE", "zh_CN"))
    registry.register("other", lambda d: d.withColumn("b", F.lit("x")), locales=("en_US",))
    registry.register("off", lambda d: d.withColumn("b", F.lit("y")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return registry.apply(rows, "zh_CN")


@query(
    """SELECT o_orderkey, para, n, text FROM (SELECT o_orderkey, 1 AS para, 0 AS n, 'To ' || o_orderpriority AS text FROM orders
UNION ALL SELECT o_orderkey, 2, l_linenumber - 1, l_linenumber || '. ' || l_quantity::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, 3, 0, 'End {{stamp}}' FROM orders)"""
)
def U1_special_handlers(spark, sf_dir):
    """A letter for each order: one handler writes a paragraph for each of its lines; one of another locale does nothing, and one that Spark refuses is left out."""
    registry = G.FieldRegistry()
    registry.register("letters", lambda d: d, special=("items", "bad"))
    registry.register("stamps", lambda d: d, special=("stamp",), locales=("en_US",))

    def items(template, records):
        rest, own = template.filter("text <> '{{items}}'"), template.filter("text = '{{items}}'").drop("text", "n")
        lines = records.select("o_orderkey", F.explode("items").alias("i"))
        return rest.unionByName(own.join(lines, "o_orderkey").select("o_orderkey", "para", (F.col("i.no") - 1).alias("n"), cat(F.col("i.no").cast("string"), ". ", F.col("i.amount").cast("string")).alias("text")))

    registry.register_handler("items", items)
    registry.register_handler("stamp", lambda t, r: t.withColumn("text", F.replace("text", F.lit("{{stamp}}"), F.lit("!"))))
    registry.register_handler("bad", lambda t, r: t.select("nothing"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    item = F.struct(F.col("l_linenumber").cast("int").alias("no"), F.col("l_quantity").cast("bigint").alias("amount"))
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("items"))
    texts = F.array(cat("To ", F.col("o_orderpriority")), F.lit("{{items}}"), F.lit("End {{stamp}}"))
    letter = orders.select("o_orderkey", F.posexplode(texts).alias("p", "text")).select("o_orderkey", (F.col("p") + 1).alias("para"), F.lit(0).alias("n"), "text")
    return registry.fill_special(letter, records, "zh_CN")[0]


def invoice_texts(spark, sf_dir):
    """An invoice for each order; every 7th has digits read as letters, every 11th a wrong total, every 13th no number."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    number = F.concat(F.lit("9999"), F.lpad(F.col("k").cast("string"), 16, "0"))
    number = F.when(F.col("k") % 7 == 0, F.translate(number, "01", "Ol")).otherwise(number)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    money = lambda c: F.concat((F.floor(c / 100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    total = cents + 600 + F.when(F.col("k") % 11 == 0, 1).otherwise(0)
    text = cat(
        "电子发票（普通发票）\n", F.when(F.col("k") % 13 == 0, "").otherwise(cat("发票号码： ", number)), "\n开票日期：", F.date_format("o_orderdate", "yyyy年MM月dd日"), "\n购买方信息 名称：买", F.col("o_custkey").cast("string"),
        " 统一社会信用代码/纳税人识别号：91310000MA1K", F.lpad(F.col("o_custkey").cast("string"), 6, "0"), "\n销售方信息 名称：卖方 统一社会信用代码：91310000MA1K999999\n项目名称 …\n合 计 ¥", money(cents), " ¥6.00\n价税合计（大写） 圆 （小写）¥", money(total), "\n开票人：李",
    )
    return o.select("o_orderkey", text.alias("text"))


_CENTS = "round(o_totalprice * 100)::BIGINT"
_MONEY = lambda c: f"({c} // 100) || '.' || lpad(({c} % 100)::VARCHAR, 2, '0')"
_TOTAL = f"({_CENTS} + 600 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END)"


@query(
    f"""SELECT o_orderkey, '电子发票（普通发票）' AS kind, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '9999' || lpad(o_orderkey::VARCHAR, 16, '0') END AS number, strftime(o_orderdate, '%Y年%m月%d日') AS issued, '买' || o_custkey AS buyer,
  '91310000MA1K' || lpad(o_custkey::VARCHAR, 6, '0') AS buyer_id, '卖方' AS seller, '91310000MA1K999999' AS seller_id, {_MONEY(_CENTS)} AS amount, '6.00' AS tax, {_MONEY(_TOTAL)} AS total, '李' AS drawer FROM orders"""
)
def I1_invoice_header(spark, sf_dir):
    found = I.invoice_header(invoice_texts(spark, sf_dir))
    names = {"发票种类": "kind", "发票号码": "number", "开票日期": "issued", "购买方名称": "buyer", "购买方纳税人识别号": "buyer_id", "销售方名称": "seller", "销售方纳税人识别号": "seller_id", "金额": "amount", "税额": "tax", "价税合计": "total", "开票人": "drawer"}
    return found.select("o_orderkey", *(F.col(a).alias(b) for a, b in names.items()))


@query(
    """SELECT o_orderkey, '0' || lpad(o_orderkey::VARCHAR, 11, '0') AS code, lpad(o_orderkey::VARCHAR, 8, '0') AS number, strftime(o_orderdate, '%Y年%m月%d日') AS issued, '5' || lpad(o_orderkey::VARCHAR, 19, '0') AS check_code,
  '甲行' || o_custkey AS buyer_bank, CASE WHEN o_orderkey % 3 = 0 THEN '乙行' || o_custkey ELSE '及账号:甲行' || o_custkey || '销售方信息、收款帐号：6222' || lpad(o_custkey::VARCHAR, 10, '0') || ' 6222' || lpad(o_custkey::VARCHAR, 10, '0') END AS seller_bank
FROM (SELECT o_orderkey, o_custkey, DATE '2021-03-04' + (o_orderkey % 300)::INTEGER AS o_orderdate FROM orders)"""
)
def I1_invoice_by_digits(spark, sf_dir):
    """No labels but those of the banks: even orders have a date and a number, odd ones' number follows the date's digits; a third has a bank of the seller, others an account for payment."""
    k, bank = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    day = F.date_add(F.lit("2021-03-04").cast("date"), (k % 300).cast("int"))
    number = F.when(k % 2 == 0, cat("开票日期：", F.date_format(day, "yyyy年M月d日"), "、", padded(8))).otherwise(cat(F.date_format(day, "yyyyMMdd"), padded(8)))
    seller = F.when(k % 3 == 0, cat("开户行及账号：乙行", bank, "项目名称")).otherwise(cat("、收款帐号：6222", F.lpad(bank, 10, "0"), "校验码"))
    text = cat("0", padded(11), "、5", padded(19), "、", number, "\n购买方信息 开户行及账号:甲行", bank, " 销售方信息", seller)
    found = I.invoice_header(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), by_digits=True)
    names = {"发票代码": "code", "发票号码": "number", "开票日期": "issued", "校验码": "check_code", "购买方开户行及账号": "buyer_bank", "销售方开户行及账号": "seller_bank"}
    return found.select("o_orderkey", *(F.col(a).alias(b) for a, b in names.items()))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS line_no, '*kind*goods ' || p AS name, CASE WHEN l_linenumber % 2 = 0 THEN q || 'kg' ELSE '' END AS model, CASE WHEN l_linenumber % 3 > 0 THEN '盒' ELSE '' END AS unit,
  q::VARCHAR AS quantity, '1.5' AS price, q || '.50' AS amount, CASE WHEN p % 2 = 0 THEN '免税' ELSE '13%' END AS rate, CASE WHEN p % 2 = 0 THEN '***' ELSE '0.' || q END AS tax FROM l"""
)
def I2_invoice_lines_from_text(spark, sf_dir):
    """Every other order has its items' parts in lines of their own; models and units are missing here and there."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").cast("string").alias("q"))
    n, odd = F.col("l_linenumber"), F.col("p") % 2 == 1
    parts = [cat("*kind*goods ", F.col("p").cast("string")), F.when(n % 2 == 0, cat(F.col("q"), "kg")), F.when(n % 3 > 0, F.lit("盒")), F.col("q"), F.lit("1.5"), cat(F.col("q"), ".50"), F.when(odd, "13%").otherwise("免税"), F.when(odd, cat("0.", F.col("q"))).otherwise("***")]
    item = F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws(" ", *parts)).otherwise(F.concat_ws("\n", *parts))
    piled = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("t")))).alias("i"))
    head, foot = "发票号码：1\n项目名称 规格型号 单 位 数 量 单 价 金 额 税率/征收率 税 额\n", "\n合     计 ¥242.38 ¥14.02\n价税合计（大写）\n*other*line 1 2 3 13% 1"
    texts = piled.select("l_orderkey", cat(head, F.array_join(F.transform("i", lambda x: x["t"]), "\n"), foot).alias("text"))
    found = I.invoice_lines_from_text(texts, ["l_orderkey"])
    names = {"商品名称": "name", "规格型号": "model", "单位": "unit", "数量": "quantity", "单价": "price", "金额": "amount", "税率": "rate", "税额": "tax"}
    return found.select("l_orderkey", "line_no", *(F.col(a).alias(b) for a, b in names.items()))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS line_no, '*a*part' || p AS name, q::VARCHAR AS quantity, '6.00' AS amount, '0.' || q || ' x' AS tax FROM l"""
)
def I3_invoice_lines_from_spans(spark, sf_dir):
    """Each line's name goes on in a second line; the tax has two spans; heights differ a little; the totals follow."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"))
    s = lambda x, y, t: F.struct(F.lit(float(x)).alias("x0"), (y if not isinstance(y, (int, float)) else F.lit(float(y))).cast("double").alias("y0"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    y = F.col("l_linenumber") * 20 + 100
    own = lines.select("l_orderkey", F.explode(F.array(s(10, y, "*a*part"), s(12, y + 8, F.col("p").cast("string")), s(200, y + 0.5, F.col("q").cast("string")), s(300, y, "6.00"), s(400, y + 1, cat("0.", F.col("q").cast("string"))), s(420, y, "x"), s(290, y, "¥"))).alias("s"))
    fixed = F.array(s(20, 100, "项目名称"), s(190, 100, "数 量"), s(295, 100, "金 额"), s(405, 100, "税额"), s(30, 2000, "合"), s(60, 2000, "计"), s(300, 2000, "12.00"))
    rows = own.unionByName(lines.select("l_orderkey").distinct().select("l_orderkey", F.explode(fixed).alias("s")))
    found = I.invoice_lines_from_spans(rows.select("l_orderkey", "s.*"), ["l_orderkey"])
    return found.select("l_orderkey", "line_no", F.col("商品名称").alias("name"), F.col("数量").alias("quantity"), F.col("金额").alias("amount"), F.col("税额").alias("tax"))


@query("SELECT o_orderkey, f AS field, CASE f WHEN 'number' THEN 'N' || o_orderkey ELSE o_orderpriority END AS text FROM orders, (VALUES ('number'), ('date')) AS t(f)")
def I4_header_from_spans(spark, sf_dir):
    """Labels and values in lines that are 10 apart; a farther value to the right and a value of the next line don't count."""
    key, pri = cat("N", F.col("o_orderkey").cast("string")), F.col("o_orderpriority")
    s = lambda x, y, t: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(y + 2)).alias("y1"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(s(10, 100, "Number :"), s(40, 101.5, key), s(90, 100, "far"), s(10, 110, "Date"), s(30, 109, pri), s(25, 113.5, "low"))).alias("s"))
    return I.header_from_spans(rows.select("o_orderkey", "s.*"), {"Number": "number", "Date": "date"}, ["o_orderkey"])


@query("SELECT o_orderkey, (o_orderkey % 13 = 0)::INTEGER AS missing, o_orderkey % 11 = 0 AS mismatch, o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AS ok FROM orders")
def I5_check_invoices(spark, sf_dir):
    return I.check_invoices(I.invoice_header(invoice_texts(spark, sf_dir)), ["o_orderkey"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN ['name', 'status'] WHEN o_orderkey % 2 = 0 THEN ['name'] ELSE ['status'] END AS fields,
  CASE WHEN o_orderkey % 6 = 0 THEN ['ab***ef', '*'] WHEN o_orderkey % 2 = 0 THEN ['ab***ef'] ELSE ['*'] END AS "left", CASE WHEN o_orderkey % 6 = 0 THEN ['****', ''] WHEN o_orderkey % 2 = 0 THEN ['****'] ELSE [''] END AS "right"
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"""
)
def I6_compare_extractions(spark, sf_dir):
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("abcdeef").alias("name"), F.substring("o_orderstatus", 1, 1).alias("status"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "wxyz").otherwise("abcdeef").alias("name"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.substring("o_orderstatus", 1, 1)).alias("status"))
    return I.compare_extractions(a, b, ["o_orderkey"], ["name", "status"])


@query("SELECT source, count(*) AS n_pages, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS chars, count(*) FILTER (length(regexp_replace(text, '\\s+', '', 'g')) < 400) AS scans FROM documents GROUP BY source")
def I7_text_layer_stats(spark, sf_dir):
    return I.text_layer_stats(table(spark, sf_dir, "documents"), ["source"], least=400)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN list_sort(list_distinct([p_size, p_size + 1, p_size + 2, 7, 9])) END AS pages FROM part")
def B1_parse_page_ranges(spark, sf_dir):
    s = F.col("p_size")
    text = cat((s + 2).cast("string"), "-", s.cast("string"), "， 7;", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise("9"), " ;7")
    return table(spark, sf_dir, "part").select("p_partkey", B.parse_page_ranges(text).alias("pages"))


@query("SELECT conv_id, turn, CASE WHEN max(turn) OVER (PARTITION BY conv_id) < 2 THEN 0 WHEN turn < 2 THEN 1 ELSE 2 END AS part FROM conversations")
def B2_split_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("page_no"))
    chosen = pages.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id", F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")).alias("pages"))
    return B.split_pages(pages, chosen, ["conv_id"]).drop("page_no")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn)::INTEGER AS merged_no FROM conversations")
def B3_merge_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 10).alias("g"))
    return B.merge_pages(pages, ["g"], ["conv_id", "turn"]).drop("g")


_EXT = "CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'XLSX' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' ELSE 'zip' END"


def named(spark, sf_dir):
    k = F.col("doc_id") % 5
    ext = F.when(k == 0, "md").when(k == 1, "XLSX").when(k == 2, "pdf").when(k == 3, "docx").otherwise("zip")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", ext.alias("ext"), cat(F.col("source"), "/", F.col("doc_id").cast("string"), ".", ext).alias("path"))


_CAT = "CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'layout' WHEN 3 THEN 'document' ELSE 'unknown' END"


@query(f"SELECT source || '/' || doc_id || '.' || {_EXT} AS path, {_CAT} AS category, count(*) OVER (PARTITION BY {_CAT}) AS n FROM documents WHERE doc_id % 5 <> 4")
def B4_categorize_files(spark, sf_dir):
    return B.categorize_files(named(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT source, {_CAT} AS category, count(*) AS n FROM documents WHERE doc_id % 5 <> 4 GROUP BY ALL)
SELECT source, category, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, list_position(['text', 'document', 'spreadsheet', 'layout', 'image'], category)) = 1"""
)
def B5_dominant_category(spark, sf_dir):
    files = named(spark, sf_dir).withColumn("category", B.category_of(F.col("ext")))
    return B.dominant_category(files, ["source"])


@query(
    """WITH r AS (SELECT source, doc_id, CASE WHEN n_chars > 12000 THEN 'failed' WHEN n_chars < 300 THEN 'skipped' ELSE 'success' END AS status FROM documents),
s AS (SELECT *, coalesce(max(status = 'failed') OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM r)
SELECT source, count(*) AS total, count(*) FILTER (NOT stopped) AS processed, count(*) FILTER (NOT stopped AND status = 'success') AS success, count(*) FILTER (NOT stopped AND status = 'failed') AS failed,
       count(*) FILTER (NOT stopped AND status = 'skipped') AS skipped, 0::BIGINT AS cancelled FROM s GROUP BY source"""
)
def B6_batch_summary(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("file_no"), F.when(n > 12000, "failed").when(n < 300, "skipped").otherwise("success").alias("status"))
    return B.batch_summary(rows, ["source"], continue_on_error=False)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' END AS format FROM pages")
def S2_detect_format(spark, sf_dir):
    k = F.col("page_id") % 4
    head = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 1, F.lit("%PDF-1.7").cast("binary")).when(k == 2, F.unhex(F.lit("504B0304"))).otherwise(F.lit("").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", S.magic_format(F.concat(head, F.col("html").cast("binary"))).alias("format"))


CONTAINERS = (
    ("xlsx", "zip", ("xl/workbook.xml",)), ("docx", "bin", ("word/document.xml",)), ("ofd", "OFD", ("OFD.xml",)), ("odt", "odt", ("mimetype",)), ("xps", "zip", ("Documents/1/Pages/1.fpage",)), ("ods", "ods", ("other.bin",)),
    ("et", "et", ("Workbook",)), ("wps", "wps", ("WordDocument",)), ("unknown", "exe", ()), ("rtf", "RTF", ()),
)


@query(f"SELECT page_id, {[k for k, *_ in CONTAINERS]}[page_id % 10 + 1] AS format FROM pages")
def S2_detect_container(spark, sf_dir):
    """Packed files by their members (one by its extension), compound files by their streams and extension, other binary files by extension."""

    def made(kind, members):
        if kind in ("et", "wps"):
            return S.compound_file(members)
        return S.packed_file({m: S.ODF + "text" if m == "mimetype" else "x" for m in members}) if members else bytes(range(256))

    k = (F.col("page_id") % 10 + 1).cast("int")
    content = F.element_at(F.array(*(F.unhex(F.lit(made(kind, members).hex())) for kind, _, members in CONTAINERS)), k)
    ext = F.element_at(F.array(*(F.lit(e) for _, e, _ in CONTAINERS)), k)
    return table(spark, sf_dir, "pages").select("page_id", S.detect_format(content, ext).alias("format"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'csv' WHEN 2 THEN 'csv' ELSE 'txt' END AS format FROM documents")
def S3_detect_text_format(spark, sf_dir):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    text = F.when(k == 0, cat("# ", i, "\n", F.col("text"))).when(k == 1, cat(i, ";b;c\n1;2;3\n\nx;y;z")).when(k == 2, cat(i, ",b\n1,2")).otherwise(cat(i, "\nplain"))
    return table(spark, sf_dir, "documents").select("doc_id", S.detect_text_format(text, F.when(k == 2, "csv").otherwise("txt")).alias("format"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'md' WHEN 2 THEN 'txt' WHEN 3 THEN 'png' WHEN 4 THEN 'csv' END AS format FROM documents")
def S3_detect_file_format(spark, sf_dir):
    """Markdown in UTF-8 with the document's text, its text among NULs, words in GBK, an image, a table, and bytes of no encoding."""
    k, text = F.col("doc_id") % 6, F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    hexed = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(k == 0, F.concat(F.encode(F.lit("# 中文\n"), "UTF-8"), text)).when(k == 1, F.concat(hexed("00" * 2000), text)).when(k == 2, F.unhex(F.repeat(F.lit("D6D0CEC420"), (F.col("doc_id") % 3000).cast("int") + 1)))
        .when(k == 3, F.concat(hexed("89504E470D0A1A0A"), text)).when(k == 4, hexed("D6D02C622C630A312C322C330A")).otherwise(F.concat(hexed("FFFE41FF"), text))
    )
    return table(spark, sf_dir, "documents").select("doc_id", S.detect_file_format(content, F.lit("txt")).alias("format"))


@query(
    """WITH b AS (SELECT page_id, page_id // 10 AS bucket, page_id // 10 % 6 AS k, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id // 10 % 6 < 4),
f AS (SELECT k, bucket, count(*) AS n, sum(CASE k WHEN 0 THEN strlen(url) + strlen(html) + 4 WHEN 1 THEN length(page_id::VARCHAR) + 5 WHEN 2 THEN length(regexp_replace(html, '[^A-Za-z ]', '', 'g')) + 1 ELSE length(page_id::VARCHAR) + 13 END)::BIGINT AS length FROM b GROUP BY ALL),
d AS (SELECT *, CASE WHEN k = 0 THEN 'md' WHEN k = 1 AND n > 1 THEN 'csv' ELSE 'txt' END AS detected, CASE WHEN k = 3 THEN 'json' ELSE 'txt' END AS ext FROM f)
SELECT CASE k WHEN 0 THEN 'notes' WHEN 1 THEN 'tables' WHEN 2 THEN 'plain' ELSE 'records' END AS kind, bucket, length, ext, detected, CASE WHEN detected = 'csv' THEN 'spreadsheet' ELSE 'text' END AS category,
  ext = detected AS is_match, k <> 3 AS is_supported, k <> 3 AS is_valid, CASE WHEN ext = detected THEN '' ELSE 'mismatch' END AS warning FROM d"""
)
def S1_read_corpus(spark, sf_dir):
    """Ten pages a file: notes and tables named as plain text, plain text, records of JSON, columnar files, which are none of ours, and an ignored folder. Read back, told by content and held against their names."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.floor(F.col("page_id") / 10).alias("bucket"))
    kinds = ("notes", "tables", "plain", "records", "columns", "node_modules")
    rows = pages.withColumn("kind", F.get(F.array(*map(F.lit, kinds)), (F.col("bucket") % 6).cast("int")))
    number = F.col("page_id").cast("string")
    bare = F.regexp_replace("html", "[^A-Za-z ]", "")
    value = F.when(F.col("kind") == "notes", cat("# ", F.col("url"), "\n", F.col("html"))).when(F.col("kind") == "tables", cat(number, ",", (F.col("page_id") % 7).cast("string"), ",x")).otherwise(bare)
    folder = shared_path(spark)
    written = lambda some, *cs: rows.filter(some).select("kind", "bucket", *cs).repartition("kind", "bucket").write.partitionBy("kind", "bucket").mode("append")
    written(F.col("kind").isin("notes", "tables", "plain"), value.alias("value")).text(folder)
    written(F.col("kind") == "records", "page_id").json(folder)
    written(F.col("kind") == "columns", "page_id").parquet(folder)
    rows.filter("kind = 'node_modules'").select(bare.alias("value"), "bucket").repartition("bucket").write.partitionBy("bucket").text(f"{folder}/node_modules")
    files = S.read_corpus(spark, folder, detected=True).withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1))
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    found = materialise(S.validate_files(files.select(part("kind"), part("bucket").cast("bigint").alias("bucket"), "length", "ext", "detected")))
    delete(spark, folder)
    return found


@query(
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'text' WHEN 3 THEN 'document' ELSE 'unknown' END AS category, doc_id % 5 IN (0, 1) AS is_match, doc_id % 5 <> 4 AS is_supported, doc_id % 5 <> 4 AND n_chars >= 300 AS is_valid,
  CASE WHEN n_chars < 300 THEN 'empty' WHEN doc_id % 5 IN (3, 4) THEN 'unverifiable' WHEN doc_id % 5 = 2 THEN 'mismatch' ELSE '' END AS warning FROM documents"""
)
def S4_validate_files(spark, sf_dir):
    k = F.col("doc_id") % 5
    files = named(spark, sf_dir).select("doc_id", "ext", F.when(k == 0, "markdown").when(k == 1, "xlsx").when(k == 2, "md").alias("detected"), F.when(F.col("n_chars") < 300, 0).otherwise(1).alias("length"))
    return S.validate_files(files).drop("ext", "detected", "length")


@query("SELECT p_partkey, r AS row, c AS col, CASE c WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand || ';q' END AS value FROM part, (VALUES (1), (2)) AS a(r), (VALUES (1), (2), (3)) AS b(c)")
def S5_read_csv_cells(spark, sf_dir):
    """The separator differs by part; the last cell is quoted."""
    k = F.col("p_partkey") % 3
    sep = F.when(k == 0, ",").when(k == 1, "\t").otherwise("|")
    line = F.concat(F.concat_ws("", F.col("p_name"), sep, F.col("p_type"), sep), F.lit('"'), F.col("p_brand"), F.lit(';q"\n'))
    files = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(line, line), "UTF-8").alias("content"))
    return S.read_csv_cells(files, ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'num' ELSE 'str' END AS vtype FROM lineitem")
def S6_type_csv_cells(spark, sf_dir):
    k = F.col("l_orderkey") % 3
    value = F.when(k == 0, (-F.col("l_partkey") - 1).cast("string")).when(k == 1, F.col("l_quantity").cast("string")).otherwise(cat("0", F.col("l_partkey").cast("string")))
    return S.type_csv_cells(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))).drop("value")


@query("SELECT o_custkey AS sheet, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS row, o_orderpriority || ',,\"a,\"\"b\"\"\"' AS line FROM orders")
def S7_sheet_csv_lines(spark, sf_dir):
    n = table(spark, sf_dir, "orders").withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    cells = n.select(F.col("o_custkey").alias("sheet"), "row", F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("o_orderpriority").alias("value")), F.struct(F.lit(3).alias("col"), F.lit('a,"b"').alias("value")))).alias("c")).select("sheet", "row", "c.*")
    return S.sheet_csv_lines(cells, ["sheet"])


@query(
    """SELECT c_custkey, concat_ws(chr(10), '---', 'title: ' || c_name, 'key: ' || chr(39) || c_custkey || chr(39), 'aliases:', '  - ' || chr(39) || 'a: ' || c_mktsegment || chr(39), '  - ' || chr(39) || '[x]' || chr(39), 'note:', '---', '') AS yaml FROM customer"""
)
def S8_render_front_matter(spark, sf_dir):
    entry = lambda k, *vs: F.struct(F.lit(k).alias("key"), F.array(*vs).alias("values"))
    record = F.array(entry("title", F.col("c_name")), entry("key", F.col("c_custkey").cast("string")), entry("aliases", cat("a: ", F.col("c_mktsegment")), F.lit("[x]")), entry("note", F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.render_front_matter(record).alias("yaml"))


@query("SELECT p_partkey, '| a | b\\|c |' || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '| ' || p_name || ' | ' || p_brand || ' x |' ELSE '| not recognised |  |' END AS md FROM part")
def S9_render_markdown_table(spark, sf_dir):
    rows = F.when(F.col("p_partkey") % 2 == 0, F.array(F.array(F.col("p_name"), cat(F.col("p_brand"), "\nx")))).otherwise(F.array().cast("array<array<string>>"))
    return table(spark, sf_dir, "part").select("p_partkey", S.render_markdown_table(F.array(F.lit("a"), F.lit("b|c")), rows).alias("md"))


@query(
    """WITH n AS (SELECT p_partkey, p_brand || '_s_20240101_000000' AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, s || CASE WHEN i > 0 THEN '_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') ELSE '' END AS name FROM n"""
)
def S10_output_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", cat(F.col("p_brand"), "_20200101_121212_old").alias("stem"))
    return S.output_names(rows, ["p_partkey"], F.col("stem"), F.lit("s"), F.lit("20240101_000000"), F.lit("")).drop("stem")
