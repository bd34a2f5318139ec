"""Markdown and source-code corpora that Spark derives from the given tables.

The tables hold no Markdown, so each row of a table is rendered as one document.  The
rendering is a projection: it grows with its table, needs no shuffle, and what a document
contains follows from the row, which lets plain SQL over the tables state the facts and
violations the document operators must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

HOME, REPO = "~/.books/", "books/"

# Which customer segment an order of each priority says it reads about.
SEGMENT_OF_PRIORITY = {
    "1-URGENT": "BUILDING",
    "2-HIGH": "AUTOMOBILE",
    "3-MEDIUM": "MACHINERY",
    "4-NOT SPECIFIED": "HOUSEHOLD",
    "5-LOW": "FURNITURE",
}


def lines(*parts) -> Column:
    """Join lines with line feeds; a NULL line is left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def say(template: str, *columns: str) -> Column:
    """``say('a {} b', 'x')``: text with the columns put in place of the ``{}``."""
    texts = template.split("{}")
    parts: list[Column] = []
    for i, text in enumerate(texts):
        parts.append(F.lit(text))
        if i < len(columns):
            parts.append(F.col(columns[i]).cast("string"))
    return F.concat(*parts)


def render(rows: DataFrame, path: Column, text: Column, *more: str) -> DataFrame:
    """``(path, text)`` documents.

    The narrow source rows are dealt by path first: files of few row groups would leave the
    rendering, and all that is done in the row after it, to few tasks.  Rendered through a
    generator: a filter on the text stays above it, where pushing it below would render every
    document a second time just to test it.
    """
    return rows.repartition(path).select(F.inline(F.array(F.struct(path.alias("path"), text.alias("text"), *more))))


def order_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One working document per order: references, a call with payload, a table, a diagram."""
    orders = table(spark, folder, "orders")
    mapping = F.create_map(*[F.lit(x) for pair in SEGMENT_OF_PRIORITY.items() for x in pair])
    orders = orders.withColumn("seg", F.try_element_at(mapping, F.col("o_orderpriority"))).withColumn(
        "day", F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    text = lines(
        "---",
        say("name: {}", "o_orderkey"),
        say("status: {}", "o_orderstatus"),
        "---",
        say("# Order {}", "o_orderkey"),
        say("## Priority {} ({})", "o_orderpriority", "day"),
        say('apply "## Priority {}"', "o_orderpriority"),
        say("Read `~/.books/customer/c{}.md`", "o_custkey"),
        "Read `{base}/notes.md`",
        say('apply "## Segment {}"', "seg"),
        say("subagent_type=c{}", "o_custkey"),
        "```",
        say("AMOUNT: {}", "o_totalprice"),
        say("STATUS_{}: yes", "o_orderstatus"),
        "(only if urgent) RUSH: 1",
        "```",
        "| id | parent | spec |",
        "|---|---|---|",
        say("| CR-{} | UR-{} | SP-{}-001.002 |", "o_orderkey", "o_custkey", "o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", F.lit("| open | {STATUS_P} |")),
        say("## Seen on {}", "day"),
        "```mermaid",
        "graph LR",
        say("  c{}[customer] --> o{}[order]", "o_custkey", "o_orderkey"),
        F.when(F.col("o_orderstatus") == "F", say("  o{}[order --> done", "o_orderkey")),
        "```",
    )
    return render(orders, say("skills/order/{}.md", "o_orderkey"), text)


def customer_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One definition file per customer; those of one segment have moved to the archive."""
    text = lines(
        "---",
        F.when(F.col("c_mktsegment") == "FURNITURE", say("name: {}", "c_name")).otherwise(say("name: c{}", "c_custkey")),
        "---",
        say("# Customer {}", "c_custkey"),
        say("## Segment {} (nation {})", "c_mktsegment", "c_nationkey"),
        F.when(
            F.col("c_acctbal") >= 0,
            lines(
                "### Inputs (provided by the caller)",
                "- `AMOUNT`: total of the order",
                "- `STATUS_O`, `STATUS_F`: state of the order, see `IGNORED_KEY`",
                "- `CURRENCY` (optional): of the amount",
                "### Optional inputs",
                "- `RUSH`: deliver first",
                "### Notes",
                "- `NOT_AN_INPUT`: outside the input sections",
            ),
        ),
    )
    home = F.when(F.col("c_mktsegment") == "MACHINERY", "archive").otherwise("books")
    customers = table(spark, folder, "customer")
    return render(customers, F.concat(home, say("/customer/c{}.md", "c_custkey")), text)


def template_docs(spark: SparkSession, folder: str) -> DataFrame:
    """A template per part with its placeholder, and a note per line item naming parts sent back."""
    templates = render(
        table(spark, folder, "part"),
        say("skills/part/templates/{}.md", "p_partkey"),
        say("size {} slot {P_{}} in {DB}", "p_size", "p_partkey"),
    )
    notes = render(
        table(spark, folder, "lineitem"),
        say("skills/return/{}-{}.md", "l_orderkey", "l_linenumber"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45), say("sent back {P_{}}", "l_partkey")).otherwise(F.lit("kept")),
    )
    return templates.unionByName(notes)


def run_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One note per event holding a script call, broken over two lines by a continuation."""
    text = lines(
        say("Run `{}.py u{} \\", "event_type", "user_id"),
        F.concat(F.lit("  --k"), F.get_json_object("props", "$.k"), F.lit(" --amount 1` now")),
    )
    return render(table(spark, folder, "events"), say("skills/run/{}.md", "event_id"), text, "ts")


def requirement_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One requirement document per order, with defects that depend on the row."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = lines(
        F.when(status == "P", say("### {}", "o_orderstatus")).otherwise(say("### ＜{}＞", "o_orderstatus")),
        F.when(priority == "4-NOT SPECIFIED", say("#### UR-{} Order", "o_orderkey")).otherwise(
            say("#### CR-2026-{}-UR-{} Order", "o_custkey", "o_orderkey")
        ),
        F.when(priority == "5-LOW", F.lit("- **理由：** ")).otherwise(say("- **理由：** {}", "o_orderpriority")),
        F.when(priority == "3-MEDIUM", F.lit("- **分割軸：** 時系列分割")).when(priority == "2-HIGH", F.lit("- **分割軸：** other")),
        say("##### ＜{}＞", "o_orderpriority"),
        say("###### CR-2026-{}-SR-{}-001 Ship", "o_custkey", "o_orderkey"),
        F.when(priority == "1-URGENT", F.lit("- **理由：** late")),
        "**＜terms＞**",
        F.when(status == "O", say("- **CR-2026-{}-SP-{}-001.001**: total TBD", "o_custkey", "o_orderkey")).otherwise(
            say("- **CR-2026-{}-SP-{}-001.001**: total due", "o_custkey", "o_orderkey")
        ),
        F.when(status == "F", say("- **CR-2026-{}-SP-{}-001.002**: Total  due", "o_custkey", "o_orderkey")),
        F.when(status == "P", F.lit("**＜later＞**")),
        "",
        "| 要求ID（親） | 要求ID（子） | 仕様ID | 設計 |",
        "|---|---|---|---|",
        say("| UR-{} | SR-{}-001 | SP-{}-001, SP-{}-002 | |", "o_custkey", "o_orderkey", "o_orderkey", "o_orderkey"),
    )
    return render(table(spark, folder, "orders"), say("req/{}.md", "o_orderkey"), text)


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """One source file per customer, order and invoice (of finished orders).

    Orders use their priority and call customers, invoices call their order and customers.
    """
    customers = render(
        table(spark, folder, "customer"),
        say("src/customer/{}.py", "c_custkey"),
        lines(
            say("# about customer_{}", "c_custkey"),
            say("def customer_{}(base_{}, more):", "c_custkey", "c_custkey"),
            say("    rate_{} = market * base_{}", "c_custkey", "c_custkey"),
            say("    return rate_{}", "c_custkey"),
        ),
    )
    priced = table(spark, folder, "orders").withColumn("prio", F.substring("o_orderpriority", 1, 1))
    orders = render(
        priced,
        say("src/order/{}.py", "o_orderkey"),
        lines(
            say("def order_{}():", "o_orderkey"),
            say("    total_{} = priority_{}", "o_orderkey", "prio"),
            say("    return customer_{}(fee(total_{}), 'a,b')", "o_custkey", "o_orderkey"),
        ),
    )
    invoices = render(
        priced.filter("o_orderstatus = 'F'"),
        say("src/invoice/{}.py", "o_orderkey"),
        lines(
            say("def invoice_{}():", "o_orderkey"),
            say("    net_{} = order_{}()", "o_orderkey", "o_orderkey"),
            say("    return customer_{}(fee(net_{}), 'a,b')", "o_custkey", "o_orderkey"),
        ),
    )
    return customers.unionByName(orders).unionByName(invoices)


def class_files(spark: SparkSession, folder: str) -> DataFrame:
    """A class per region, nation, customer and supplier, each heir of the row it belongs to.

    Customers in debt are exported and imported under further names.
    """
    regions = render(table(spark, folder, "region"), say("src/model/region_{}.py", "r_regionkey"), say("class Region_{}:\n    pass", "r_regionkey"))
    nations = render(
        table(spark, folder, "nation"), say("src/model/nation_{}.py", "n_nationkey"),
        say("class Nation_{}(model.Region_{}, metaclass=Meta):\n    pass", "n_nationkey", "n_regionkey"),
    )
    customers = table(spark, folder, "customer")
    classes = render(
        customers, say("src/model/customer_{}.py", "c_custkey"),
        lines(
            say("class Customer_{}(Nation_{}, Serializable):", "c_custkey", "c_nationkey"),
            say("    limit_{} = 1", "c_custkey"),
            "",
            "    def open(self):",
            say("        self.limit_{} = 2", "c_custkey"),
            "        def inner():",
            say("            return limit_{}", "c_custkey"),
            "    def close(self):",
            say("        return self.limit_{}", "c_custkey"),
            say("print(limit_{})", "c_custkey"),
        ),
    )
    names = render(
        customers.filter("c_acctbal < 0"), say("src/names/{}.js", "c_custkey"),
        lines(
            F.concat(F.lit("export { "), say("Customer_{} as Client_{}, other", "c_custkey", "c_custkey"), F.lit(" } from './model';")),
            say("import Client_{} as Debtor_{}", "c_custkey", "c_custkey"),
        ),
    )
    suppliers = render(
        table(spark, folder, "supplier"), say("src/model/supplier_{}.js", "s_suppkey"),
        lines(say("export class Supplier_{} extends base.Nation_{} implements Shipper, Payee", "s_suppkey", "s_nationkey"), "end"),
    )
    return regions.unionByName(nations).unionByName(classes).unionByName(names).unionByName(suppliers)


def diagram_docs(spark: SparkSession, folder: str) -> DataFrame:
    """A diagram per order, with faults that counting brackets doesn't see."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    text = lines(
        "```mermaid",
        F.when(priority == "5-LOW", F.lit("flowchart UP")).otherwise(F.lit("flowchart LR")),
        say("  subgraph s{}", "o_orderkey"),
        say('    c{}["a ) b --> x{}"] -->|so| o{}[(order --> y)]', "o_custkey", "o_custkey", "o_orderkey"),
        F.when(status == "F", F.lit("    p)q(")).when(status == "P", say('    o{}["never closed', "o_orderkey")).otherwise(F.lit("    q{{x}} %% a ( comment")),
        F.when(priority == "3-MEDIUM", F.lit("  end\n  end")).when(priority == "2-HIGH", F.lit("  %% end")).otherwise(F.lit("  end")),
        "```",
    )
    return render(table(spark, folder, "orders"), say("diagrams/{}.md", "o_orderkey"), text)
