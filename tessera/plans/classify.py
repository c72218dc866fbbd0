"""Classification along the policy's axes: keyword ladders as CASE expressions, families as components of token-set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.components import components
from tessera.operators.pairs import equal_sets, jaccard_pairs, set_digest
from tessera.operators.ranking import running
from tessera.scratch import Scratch

from .policy import NSFW_KEYWORDS, STYLE_KEYWORDS, Axis, Policy

# What a cluster's prompts say, in the order in which they are tried, and the label for it.
HAIR = (
    ("은발", ("silver hair", "silver-haired", "silver haired", "white hair", "white-haired", "white haired")), ("푸른머리", ("blue hair", "blue-haired", "blue haired", "aqua hair", "aqua-haired", "aqua haired")),
    ("흑발", ("black hair", "black-haired", "black haired")), ("금발", ("blonde hair", "blond hair", "blonde-haired", "blond-haired", "yellow hair")), ("갈색머리", ("brown hair", "brown-haired", "brown haired")),
    ("분홍머리", ("pink hair", "pink-haired", "pink haired")), ("적발", ("red hair", "red-haired", "red haired")), ("녹색머리", ("green hair", "green-haired", "green haired")), ("보라머리", ("purple hair", "purple-haired", "purple haired")),
)
EYES = (
    ("푸른눈", ("blue eyes", "blue-eyed", "aqua eyes", "cyan eyes")), ("붉은눈", ("red eyes", "red-eyed", "crimson eyes", "scarlet eyes")), ("녹색눈", ("green eyes", "green-eyed", "emerald eyes")),
    ("금색눈", ("gold eyes", "golden eyes", "yellow eyes", "amber eyes")), ("보라눈", ("purple eyes", "violet eyes", "purple-eyed")), ("분홍눈", ("pink eyes", "pink-eyed")), ("검은눈", ("black eyes", "black-eyed")), ("갈색눈", ("brown eyes", "brown-eyed")),
)
OUTFIT = (("검은갑옷", ("black armor", "dark armor")), ("하얀드레스", ("white dress",)), ("교복", ("school uniform",)), ("메이드복", ("maid outfit", "maid dress")), ("아이돌복", ("idol outfit", "idol costume")))
SUBJECT = (
    ("소녀", ("girl", "female", "woman", "lady")), ("소년", ("boy", "male", "man")), ("기사", ("knight",)), ("공주", ("princess",)), ("마녀", ("witch",)), ("메이드", ("maid",)), ("용", ("dragon",)),
    ("고양이소녀", ("cat girl", "catgirl")), ("천사", ("angel",)), ("악마", ("demon",)),
)
SOMEONE, SOME_GROUP = "캐릭터", "캐릭터그룹"
STYLE_TAGS = {"style_anime": "Anime", "style_realistic": "Realistic", "style_painterly": "Painterly", "style_chibi": "Chibi"}


def result(axis: Axis, label: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(axis.priority).alias("axis_priority"), F.lit(axis.criterion).alias("criterion"), T.slugify(label).alias("category_key"), label.alias("category_label"),
        confidence.cast("double").alias("confidence"), reason.alias("reason"),
    )


def ladder(axis: Axis, *steps: tuple[Column | None, Column | str, float | Column, str | Column]) -> Column:
    """The first step whose condition holds; the last one's condition is None."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for when, label, confidence, reason in steps:
        row = result(axis, lit(label), lit(confidence), lit(reason))
        out = (out.otherwise(row) if out is not None else row) if when is None else (F.when(when, row) if out is None else out.when(when, row))
    return out


def hits(text: Column, words: list[str]) -> Column:
    """The keywords, lower-cased, that occur in the text as substrings; repeated keywords count as often as they are listed."""
    return F.filter(F.array(*[F.lit(w.lower()) for w in words]) if words else F.array().cast("array<string>"), lambda w: F.contains(text, w))


def groups_hit(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the keyword groups any of whose words occurs in the text."""
    names = [F.when(F.size(hits(text, ws)) > 0, F.lit(name)) for name, ws in keywords.items()]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def character_text(prompts: Column, prompt: Column) -> Column:
    return F.when(F.size(F.coalesce(prompts, F.array().cast("array<string>"))) > 0, F.array_join(prompts, " ")).otherwise(F.coalesce(prompt, F.lit("")))


def safety(axis: Axis, policy: Policy) -> Column:
    words = policy.rule("nsfw_keywords", NSFW_KEYWORDS)
    prompt, negative = (F.lower(F.coalesce(c, F.lit(""))) for c in (F.col("prompt"), F.col("negative_prompt")))
    found = hits(prompt, words)
    return ladder(
        axis, ((prompt == "") & (negative == ""), axis.unknown_label, 0.0, "Prompt metadata is unavailable for safety classification."),
        (F.size(found) > 0, "NSFW", F.least(F.lit(0.99), 0.7 + 0.08 * F.size(found)), F.concat(F.lit("NSFW keywords matched in prompt: "), F.array_join(F.array_sort(F.array_distinct(found)), ", "))),
        (F.size(hits(negative, words)) > 0, "SFW", 0.9, "NSFW keywords appear only in the negative prompt."), (None, "SFW", 0.85, "No NSFW keywords detected in prompt metadata."),
    )


def character(axis: Axis, policy: Policy) -> Column:
    names = groups_hit(F.lower(character_text(F.col("character_prompts"), F.col("prompt"))), policy.rule("character_keywords", {}))
    one = F.get(names, F.lit(0))
    return ladder(
        axis, (F.size(names) == 1, F.concat(F.lit("Character_"), one), 0.9, F.concat(F.lit("Prompt keyword matched '"), one, F.lit("'."))),
        (F.size(names) > 1, axis.unknown_label, 0.4, F.concat(F.lit("Multiple character groups matched: "), F.array_join(names, ", "))),
        (F.col("character_family").isNotNull(), F.col("character_family"), 0.68, "Character group inferred from similar character prompt tokens."),
        (None, axis.unknown_label, 0.2, "No configured character keywords or prompt-similar character family matched."),
    )


def style(axis: Axis, policy: Policy) -> Column:
    names = groups_hit(F.lower(F.coalesce("prompt", F.lit(""))), policy.rule("style_keywords", STYLE_KEYWORDS))
    tags = F.coalesce(F.col("dominant_tags"), F.array().cast("array<string>"))
    tagged = F.array_compact(F.array(*[F.when(F.array_contains(tags, k), F.lit(v)) for k, v in STYLE_TAGS.items()]))
    of = lambda a: F.concat(F.lit("Style_"), F.get(a, F.lit(0)))
    return ladder(
        axis, (T.blank_to_null(F.col("artist")).isNotNull(), F.concat(F.lit("Style_Artist_"), T.label_token(F.col("artist"))), 0.96, "Artist metadata extracted from normalized metadata."),
        (F.col("style_family").isNotNull(), F.col("style_family"), 0.72, "Artist was null or unavailable; style inferred from similar style prompt tokens."),
        (F.size(names) == 1, of(names), 0.88, F.concat(F.lit("Prompt keyword matched '"), F.get(names, F.lit(0)), F.lit("' style."))),
        (F.size(names) > 1, axis.unknown_label, 0.35, F.concat(F.lit("Multiple style groups matched: "), F.array_join(names, ", "))),
        (F.size(tagged) == 1, of(tagged), 0.6, "Style inferred from extracted feature tags."),
        (None, axis.unknown_label, 0.15, "No configured style keywords matched the prompt or feature tags."),
    )


def model_name(model: Column, aliases: dict[str, list[str]]) -> Column:
    """Canonical name of a model: the first group that lists it, without case, or the name itself; null for none."""
    c = F.when(T.blank_to_null(model).isNull(), F.lit(None).cast("string"))
    for name, others in aliases.items():
        c = c.when(F.lower(model).isin(name.lower(), *[o.lower() for o in others]), F.lit(name))
    return c.otherwise(model)


def model(axis: Axis, policy: Policy) -> Column:
    name = model_name(F.col("model"), policy.rule("model_aliases", {}))
    return ladder(axis, (name.isNotNull(), F.concat(F.lit("Model_"), name), 0.95, "Model value extracted from normalized metadata."), (None, axis.unknown_label, 0.1, "No model metadata was available."))


def resolution(axis: Axis, policy: Policy) -> Column:
    there = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    return ladder(axis, (there, F.concat(F.lit("Resolution_"), F.col("width"), F.lit("x"), F.col("height")), 1.0, "Resolution derived from scan stage image header."), (None, axis.unknown_label, 0.0, "Resolution information is missing."))


def prompt_family(axis: Axis, policy: Policy) -> Column:
    key = T.prompt_family(F.col("prompt"))
    return ladder(axis, (key.isNotNull(), F.concat(F.lit("PromptFamily_"), key), 0.75, "Prompt family derived from normalized prompt text hash."), (None, axis.unknown_label, 0.0, "No normalized prompt was available."))


def similarity(axis: Axis, policy: Policy) -> Column:
    return ladder(
        axis, (T.blank_to_null(F.col("perceptual_hash")).isNotNull(), axis.unknown_label, 0.3, "Similarity grouping is deferred to stage 9; placeholder assigned."),
        (None, axis.unknown_label, 0.0, "Feature hash is unavailable for similarity pre-classification."),
    )


def none(axis: Axis, policy: Policy) -> Column:
    return ladder(axis, (None, axis.unknown_label, 0.0, f"{axis.criterion} classifier is not implemented in stage 8."))


CRITERIA = {"safety": safety, "character": character, "style": style, "model": model, "resolution": resolution, "prompt_family": prompt_family, "similarity": similarity, "none": none}


def keyword_tokens(keywords: dict[str, list[str]]) -> list[str]:
    """Tokens of all names and keywords of a rule."""
    import re

    words = [w for name, ws in keywords.items() for s in (name, *ws) for w in re.findall("[a-z0-9_]+", s.lower())]
    return sorted({w for w in words if len(w) > 2 and w not in T.FAMILY_STOPWORDS})


def style_tokens(policy: Policy) -> Column:
    """Of rows without an artist: tokens of the signature or prompt that name no character."""
    drop = F.array(*map(F.lit, [*keyword_tokens(policy.rule("character_keywords", {})), *T.STYLE_DROP]))
    return F.when(T.blank_to_null(F.col("artist")).isNull(), F.array_except(T.tokens(F.coalesce("extra.style_signature", "prompt", F.lit(""))), drop)).otherwise(F.array().cast("array<string>"))


def character_tokens(policy: Policy) -> Column:
    drop = F.array(*map(F.lit, [*keyword_tokens(policy.rule("style_keywords", {})), *T.CHARACTER_DROP]))
    return F.array_except(T.tokens(character_text(F.col("character_prompts"), F.col("prompt"))), drop)


def families(rows: DataFrame, tokens: Column, threshold: float, prefix: str | None, scratch: Scratch, text: Column | None = None) -> DataFrame:
    """image_id, label of every row in a cluster of two or more whose token sets are linked by Jaccard >= threshold, over all rows.

    Clusters are numbered by their first file name (without case, then by smallest id); a label that came before gets a counter. With
    `prefix` None labels come from the texts of the members, in order of file names. That numbering is over clusters, after
    aggregation; the only thing gathered per cluster is text, for its label.
    """
    rows = scratch.table(rows.select("image_id", "file_name", tokens.alias("tokens"), (text if text is not None else F.lit("")).alias("text")).where(F.size("tokens") > 0), "tokens")
    sets = scratch.table(equal_sets(rows, "image_id", F.lit(0), F.col("tokens")), "sets")
    pairs = jaccard_pairs(sets, threshold, scratch=scratch).select("a", "b")
    roots = components(pairs, scratch)
    # Rows find their set by its digest: the tokens themselves are not moved again.
    named = sets.select("rep", set_digest(F.col("tokens")).alias("digest")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("cluster"))
    member = scratch.table(rows.select("image_id", "file_name", "text", set_digest(F.array_sort("tokens")).alias("digest")).join(named, "digest").select("image_id", "file_name", "text", "cluster"), "members")
    clusters = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("file_name")).alias("first")).where("n > 1")
    clusters = running(clusters, ["first", "cluster"], F.lit(1), scratch).withColumn("number", F.col("before") + 1).drop("before")
    if prefix is None:
        # Each phrase is looked for in each text, then "any" over the cluster: no text is gathered.
        clusters = scratch.table(clusters, "clusters")
        flags = [F.max(F.contains(F.lower("text"), F.lit(p))).alias(f"p{i}") for i, p in enumerate(dict.fromkeys(p for t in (HAIR, EYES, OUTFIT, SUBJECT) for _, ps in t for p in ps))]
        where = {p: F.col(f"p{i}") for i, p in enumerate(dict.fromkeys(p for t in (HAIR, EYES, OUTFIT, SUBJECT) for _, ps in t for p in ps))}

        def first(table) -> Column:
            c = None
            for label, phrases in table:
                hit = where[phrases[0]]
                for p in phrases[1:]:
                    hit = hit | where[p]
                c = F.when(hit, label) if c is None else c.when(hit, label)
            return c

        said, subject = [first(t) for t in (HAIR, EYES, OUTFIT)], first(SUBJECT)
        label = F.when(F.coalesce(*said, subject).isNotNull(), F.concat(*[F.coalesce(s, F.lit("")) for s in said], F.coalesce(subject, F.lit(SOMEONE)))).otherwise(F.concat(F.lit(f"{SOME_GROUP}_"), F.format_string("%03d", "number")))
        clusters = member.join(clusters.select("cluster", "number"), "cluster").groupBy("cluster", "number").agg(*flags).select("cluster", "number", label.alias("label"))
    else:
        clusters = clusters.select("cluster", "number", F.concat(F.lit(f"{prefix}_"), F.format_string("%03d", "number")).alias("label"))
    again = F.row_number().over(Window.partitionBy("label").orderBy("number"))
    clusters = clusters.select("cluster", F.when(again > 1, F.concat("label", F.lit("_"), F.format_string("%02d", again))).otherwise(F.col("label")).alias("label"))
    return member.join(clusters, "cluster").select("image_id", "label")


def classify(rows: DataFrame, policy: Policy, scratch: Scratch, keep_families: bool = False) -> DataFrame:
    """`rows` with `categories`: one result per enabled axis, in order of priority. Families are found over all rows before, and may be kept as columns."""
    axes = policy.enabled()
    asked = {a.criterion for a in axes}
    none_yet = F.lit(None).cast("string")
    if "style" in asked:
        found = families(rows, style_tokens(policy), float(policy.rule("style_artist_similarity_threshold", 0.5)), "StyleFamily", scratch)
        rows = rows.join(found.withColumnRenamed("label", "style_family"), "image_id", "left")
    else:
        rows = rows.withColumn("style_family", none_yet)
    if "character" in asked:
        text = character_text(F.col("character_prompts"), F.col("prompt"))
        found = families(rows, character_tokens(policy), float(policy.rule("character_prompt_threshold", 0.42)), None, scratch, text)
        rows = rows.join(found.withColumnRenamed("label", "character_family"), "image_id", "left")
    else:
        rows = rows.withColumn("character_family", none_yet)
    return rows.withColumn("categories", F.array(*[CRITERIA[a.criterion](a, policy) for a in axes])).drop(*([] if keep_families else ["style_family", "character_family"]))


def label_counts(rows: DataFrame) -> DataFrame:
    """criterion, label, n over all categories."""
    return rows.select(F.inline("categories")).groupBy("criterion", F.col("category_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
