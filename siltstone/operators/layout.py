"""Layout of pages: outermost sections, and below each its blocks as a flattened tree.

Everything is said over the rows of ``dom.node_rows``: an element lies in a
section if its number lies in the section's range, so sections and what is in them are
windows over a page's elements in order, and no element is compared with any
other.  A block's place comes from its path.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import stable_id
from siltstone.operators import dom

# What makes an element a section: it stands right in main or body, or has one of these classes, or one of these words in its classes.
SECTION_PARENTS, SECTION_TAGS = ("main", "body"), ("section", "article", "div")
SECTION_CLASSES = ("elementor-section", "elementor-widget-wrap", "wp-block-group", "wp-block-cover", "wp-block-column")
SECTION_WORDS = ("section", "hero", "banner", "container", "wrapper", "row", "grid", "columns")
COLUMN = r"(?i)col|column|wp-block-column|grid|cell"
# Kinds of parts by tag, then by words in class, id and widget type, in order.
KINDS_BY_TAG = (
    ("form", "^form$"), ("image", "^img$"), ("video", "^video$"), ("navigation", "^a$"), ("heading", "^h[1-6]$"), ("paragraph", "^p$"), ("button", "^button$"), ("list", "^(ul|ol|li)$"),
)
KINDS_BY_WORD = (
    ("carousel", "slider|slideshow|swiper"), ("gallery", "carousel"), ("accordion", "accordion"), ("tabs", r"\btabs?\b"), ("accordion", "faq|schema-faq"), ("paragraph", "testimonial|review"),
    ("section", "grid|products|collection"), ("section", "section"), ("column", "col|column"), ("container", "container"), ("section", "banner"), ("section", "hero"), ("button", "cta|call-to-action"),
    ("form", "newsletter|subscribe"), ("icon", "icon"), ("video", "video"),
)
# Words in classes that make an element a component; forms are components too.
COMPONENT_WORDS = ("slider", "swiper", "carousel", "accordion", "tab", "faq", "testimonial", "grid", "banner", "hero", "cta", "newsletter")
# What tells the maker of a form.
FORM_MAKERS = (("Contact Form 7", "wpcf7"), ("WPForms", "wpforms"), ("Fluent Forms", "fluentform"))
ROOTS, SECTIONS, CHILDREN, FIRST_BLOCKS, BLOCKS, COMPONENTS, WIDGETS = 80, 40, 20, 20, 8, 120, 80


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def classes() -> Column:
    return F.coalesce(attribute("class"), F.lit(""))


def has_class(*names: str) -> Column:
    own = F.split(classes(), r"\s+")
    return F.arrays_overlap(own, F.array(*[F.lit(n) for n in names]))


def class_says(*words: str) -> Column:
    return reduce(Column.__or__, [F.contains(classes(), F.lit(w)) for w in words])


def kind() -> Column:
    """What kind of part an element is."""
    said = F.lower(F.concat_ws(" ", classes(), F.coalesce(attribute("id"), F.lit("")), F.coalesce(attribute("data-widget_type"), F.lit(""))))
    rules = [(name, F.col("tag").rlike(pattern)) for name, pattern in KINDS_BY_TAG] + [(name, said.rlike(pattern)) for name, pattern in KINDS_BY_WORD]
    return reduce(lambda own, rule: own.when(rule[1], F.lit(rule[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]))).otherwise(F.lit("unknown"))


def media_ids(sources: Column, page: Column) -> Column:
    """Ids of the images at ``sources``, resolved against their page; what is no address is left out."""
    whole = F.transform(F.transform(sources, lambda s: U.resolved(s, page)), U.normalized)
    return F.transform(F.filter(whole, lambda u: u.isNotNull()), lambda u: stable_id("media", u))


def in_sections(nodes: DataFrame, key: str = "url") -> DataFrame:
    """The rows of ``dom.node_rows`` (of pages known by ``key``) that lie in a section or are one, with ``section`` (from 0), its node and its depth.

    Sections are the outermost of the first ROOTS elements that look like one, at most SECTIONS; where none does, the first CHILDREN children of body.
    """
    page = Window.partitionBy(key).orderBy("node")
    before, so_far = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(key)
    body = F.min(F.when(F.col("tag") == "body", F.col("node"))).over(every)
    looks = has_class(*SECTION_CLASSES) | class_says(*SECTION_WORDS) | (F.col("tag").isin(*SECTION_TAGS) & F.col("parent_tag").isin(*SECTION_PARENTS))
    nodes = nodes.withColumn("looks", looks).withColumn("body", body)
    nodes = nodes.withColumn("looks", F.col("looks") & (F.count_if("looks").over(so_far) <= ROOTS))
    reach = F.coalesce(F.max(F.when(F.col("looks"), F.col("last"))).over(before), F.lit(-1))
    nodes = nodes.withColumn("is_root", F.col("looks") & (F.col("node") > reach)).withColumn("any_root", F.max("is_root").over(every))
    child_of_body = ~F.col("any_root") & (F.col("parent") == F.col("body")) & (F.col("nth") < CHILDREN)
    nodes = nodes.withColumn("is_root", F.col("is_root") | F.coalesce(child_of_body, F.lit(False)))
    root = F.last(F.when(F.col("is_root"), F.struct("node", "last", "depth")), ignorenulls=True).over(so_far)
    nodes = nodes.withColumn("section", F.count_if("is_root").over(so_far) - 1).withColumn("root", root)
    nodes = nodes.where((F.col("node") <= F.col("root.last")) & (F.col("section") < SECTIONS))
    return nodes.select(key, "section", F.col("root.node").alias("section_node"), F.col("root.depth").alias("section_depth"), "node", "parent", "last", "depth", "nth", "children", "path", "tag", "attrs", "lead", "sources")


def sections(nodes: DataFrame, key: str = "url") -> DataFrame:
    """A row for each section of ``in_sections``: section_id, type, tag, columns and how many elements it holds."""
    own = F.col("node") == F.col("section_node")
    columns = F.count_if((F.col("parent") == F.col("section_node")) & classes().rlike(COLUMN))
    of_root = lambda c: F.max(F.when(own, c))
    found = nodes.groupBy(key, "section").agg(
        of_root(stable_id("section", F.concat_ws("-", key, F.col("section").cast("string"), F.upper("tag"), classes()))).alias("section_id"),
        of_root(kind()).alias("type"), of_root(F.col("tag")).alias("tag"), F.greatest(columns, F.lit(1)).alias("columns"), (F.count(F.lit(1)) - 1).alias("elements"),
    )
    return found.select(key, "section", "section_id", "type", "tag", "columns", "elements")


def blocks(nodes: DataFrame, key: str = "url") -> DataFrame:
    """A row for each block of ``in_sections``: the first FIRST_BLOCKS children of a section, and of each block the first BLOCKS.

    ``node`` and ``parent`` make the tree (children of a section have its node as parent); ``level`` counts from 1; block_id is made from the
    place, the tag and the start of the text; ``place`` is the number that the place has there.
    """
    way = F.expr("substring(path, section_depth + 1)")
    nodes = nodes.withColumn("way", way).where(F.col("way").rlike(f"^[{dom.PLACES[:FIRST_BLOCKS]}][{dom.PLACES[:BLOCKS]}]*$"))
    first = F.col("section") * 100 + F.instr(F.lit(dom.PLACES), F.substring("way", 1, 1)) - 1
    place = F.regexp_replace(F.concat(first.cast("string"), F.expr("substring(way, 2)")), "^0+(?=.)", "")
    text = F.substring("lead", 1, dom.LEAD)
    return nodes.select(
        key, "section", F.length("way").alias("level"), "node", "parent", place.alias("place"), stable_id("block", F.concat_ws("-", key, place, F.upper("tag"), "lead")).alias("block_id"),
        kind().alias("type"), "tag", F.nullif(text, F.lit("")).alias("text"), media_ids(F.col("sources"), F.col(key)).alias("media"),
    )


def layout(pages: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Sections and blocks of ``pages`` (key, html); key is the page's address."""
    nodes = in_sections(dom.node_rows(pages.select(key, "html")), key)
    return sections(nodes, key), blocks(nodes, key)


def _numbered(nodes: DataFrame, key: str, those: Column, most: int) -> DataFrame:
    """The first ``most`` elements of each page for which ``those`` holds, numbered from 0 in ``place``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("node"))
    return nodes.where(those).withColumn("place", n - 1).where(F.col("place") < most)


def components(nodes: DataFrame, key: str = "url") -> DataFrame:
    """Components among the rows of ``dom.node_rows``: component_id, type, provider, tag, classes, how many children, images."""
    own = _numbered(nodes, key, class_says(*COMPONENT_WORDS) | (F.col("tag") == "form"), COMPONENTS).withColumn("type", kind())
    return own.select(
        key, "place", stable_id("component", F.concat_ws("-", key, F.col("place").cast("string"), "type")).alias("component_id"), "type", F.split(attribute("data-widget_type"), r"\.")[0].alias("provider"),
        "tag", classes().alias("classes"), F.col("children").alias("items"), media_ids(F.col("sources"), F.col(key)).alias("media"),
    )


def _first_inside(nodes: DataFrame, key: str, those: Callable[[], Column], value: Column) -> Column:
    """The value of the first element for which ``those`` holds after this one, with its node: it lies inside if its node is at most ``last``."""
    # from the end on: a frame that only grows reads each element once, one that shrinks reads all that follow for each
    after = Window.partitionBy(key).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(those(), F.struct("node", value.alias("value"))), ignorenulls=True).over(after)


def widgets(nodes: DataFrame, key: str = "url") -> DataFrame:
    """Widgets among the rows of ``dom.node_rows``: widget_id, type, title (its first heading), start of the text, images."""
    nodes = nodes.withColumn("next", _first_inside(nodes, key, lambda: F.col("tag").rlike("^h[1-6]$"), F.col("lead")))
    own = _numbered(nodes, key, F.contains(classes(), F.lit("widget")) | (F.col("tag") == "aside") | (attribute("role") == "complementary"), WIDGETS)
    title = F.when(F.col("next.node") <= F.col("last"), F.nullif(F.col("next.value"), F.lit("")))
    said = F.coalesce(F.nullif(F.trim(F.regexp_replace(classes(), r"\s+", " ")), F.lit("")), F.col("tag"))
    name = F.coalesce(attribute("class"), F.upper("tag"))
    return own.select(
        key, "place", stable_id("widget", F.concat_ws("-", key, F.col("place").cast("string"), name)).alias("widget_id"), said.alias("type"), title.alias("title"),
        F.nullif(F.col("lead"), F.lit("")).alias("text"), media_ids(F.col("sources"), F.col(key)).alias("media"),
    )


def menus(nodes: DataFrame, key: str = "url", most: int = 80) -> DataFrame:
    """Menus among the rows of ``dom.node_rows``: a row for each of the first ``most`` links of each, with the menu's number, position and name.

    Menus are nav, lists in header or footer, and breadcrumbs; the first of a page is its primary one.  A link is in every menu around it.
    """
    page = Window.partitionBy(key).orderBy("node")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda tag: F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("last"))).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    label = F.coalesce(attribute("aria-label"), F.lit(""))
    nodes = nodes.withColumn("enclosed", F.greatest(reach("header"), reach("footer")) >= F.col("node"))
    nodes = nodes.withColumn("is_menu", (F.col("tag") == "nav") | ((F.col("tag") == "ul") & F.col("enclosed")) | F.contains(F.lower(label), F.lit("breadcrumb")))
    is_link = (F.col("tag") == "a") & attribute("href").isNotNull()
    nodes = nodes.withColumn("menu", F.count_if("is_menu").over(so_far) - 1).withColumn("so_far", F.count_if(is_link).over(so_far))
    text = F.lower(F.concat_ws(" ", label, classes(), F.coalesce(attribute("id"), F.lit(""))))
    position = reduce(lambda own, x: own.when(F.contains(text, F.lit(x[0])), F.lit(x[1])), (("footer", "footer"), ("mobile", "mobile")), F.when(F.contains(text, F.lit("breadcrumb")), F.lit("breadcrumbs")))
    position = position.when(F.col("menu") == 0, F.lit("primary")).otherwise(F.lit("secondary"))
    own = nodes.where("is_menu").select(key, "menu", "so_far", F.col("last").alias("to_node"), position.alias("position"), attribute("aria-label").alias("name"))
    own = own.withColumn("name", F.coalesce("name", F.concat("position", F.lit(" menu"))))
    # links are numbered through the page, so those of a menu are a range of numbers
    links = nodes.where(is_link).select(key, F.col("so_far").alias("number"), attribute("href").alias("raw"), "lead")
    ends = nodes.select(key, F.col("node").alias("to_node"), F.col("so_far").alias("until"))
    own = own.join(ends, [key, "to_node"]).where("until > so_far")
    own = own.withColumn("number", F.explode(F.sequence(F.col("so_far") + 1, F.least("until", F.col("so_far") + most))))
    inside = own.withColumn("item", F.col("number") - F.col("so_far") - 1).join(links, [key, "number"])
    return inside.select(
        key, "menu", stable_id("menu", F.concat_ws("-", key, F.col("menu").cast("string"), "position")).alias("menu_id"), "position", "name", "item",
        stable_id("nav-item", F.concat_ws("-", key, F.col("menu").cast("string"), F.col("item").cast("string"), "lead")).alias("item_id"),
        F.coalesce(F.nullif(F.col("lead"), F.lit("")), "raw").alias("label"), F.get(F.transform(F.array(U.resolved(F.col("raw"), F.col(key))), U.normalized), 0).alias("href"),
    )


def forms(nodes: DataFrame, key: str = "url") -> DataFrame:
    """Fields of the forms among the rows of ``dom.node_rows``, a row each (a form without fields has one without a name): form_id, provider, action, method, and what a field asks for."""
    page = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    maker = reduce(lambda own, x: own.when(F.contains(classes(), F.lit(x[1])), F.lit(x[0])), FORM_MAKERS[1:], F.when(F.contains(classes(), F.lit(FORM_MAKERS[0][1])), F.lit(FORM_MAKERS[0][0])))
    is_form, is_field = F.col("tag") == "form", F.col("tag").isin("input", "textarea", "select")
    about = F.struct("node", "last", maker.alias("provider"), attribute("action").alias("action"), attribute("method").alias("method"))
    nodes = nodes.withColumn("form", F.count_if(is_form).over(page) - 1).withColumn("around", F.last(F.when(is_form, about), ignorenulls=True).over(page))
    own = nodes.where((is_field | is_form) & (F.col("node") <= F.col("around.last")))
    n = F.row_number().over(Window.partitionBy(key, "form").orderBy("node"))
    label = F.coalesce(attribute("aria-label"), attribute("placeholder"))
    own = own.withColumn("n", n - 1).withColumn("fields", F.count(F.lit(1)).over(Window.partitionBy(key, "form")) - 1)
    own = own.where((F.col("n") > 0) | (F.col("fields") == 0))
    field = lambda c: F.when(is_field, c)
    return own.select(
        key, "form", stable_id("form", F.concat_ws("-", key, F.col("form").cast("string"))).alias("form_id"), F.col("around.provider").alias("provider"), F.col("around.action").alias("action"), F.col("around.method").alias("method"),
        field(F.col("n") - 1).alias("field"), attribute("name").alias("name"), field(F.nullif(F.trim(F.regexp_replace(label, r"\s+", " ")), F.lit(""))).alias("label"), field(F.coalesce(attribute("type"), F.col("tag"))).alias("type"),
        field(F.map_contains_key("attrs", "required") | F.coalesce(attribute("aria-required") == "true", F.lit(False))).alias("required"), field(attribute("pattern")).alias("validation"),
    )
