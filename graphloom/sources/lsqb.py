"""Social-network CSV files (``|``-separated, with a header line) to node and edge rows.

Ids are made unique as ``<Type>_<id>``; nothing has properties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, all of the data set: node files with the labels of their rows; edge files of each type, named
# after source type, type and target type.
NODE_FILES = {
    **{kind: (kind,) for kind in ("Continent", "Country", "City", "University", "Company", "TagClass", "Tag", "Forum", "Person")},
    "Comment": ("Message", "Comment"),
    "Post": ("Message", "Post"),
}
EDGE_FILES = {
    "IS_PART_OF": ("Country_isPartOf_Continent", "City_isPartOf_Country"),
    "IS_SUBCLASS_OF": ("TagClass_isSubclassOf_TagClass",),
    "IS_LOCATED_IN": ("University_isLocatedIn_City", "Company_isLocatedIn_Country", "Comment_isLocatedIn_Country", "Post_isLocatedIn_Country", "Person_isLocatedIn_City"),
    "HAS_TYPE": ("Tag_hasType_TagClass",),
    "HAS_CREATOR": ("Comment_hasCreator_Person", "Post_hasCreator_Person"),
    "REPLY_OF": ("Comment_replyOf_Comment", "Comment_replyOf_Post"),
    "HAS_TAG": ("Comment_hasTag_Tag", "Post_hasTag_Tag", "Forum_hasTag_Tag"),
    "CONTAINER_OF": ("Forum_containerOf_Post",),
    "HAS_MEMBER": ("Forum_hasMember_Person",),
    "HAS_MODERATOR": ("Forum_hasModerator_Person",),
    "HAS_INTEREST": ("Person_hasInterest_Tag",),
    "KNOWS": ("Person_knows_Person_bidirectional",),
    "LIKES": ("Person_likes_Comment", "Person_likes_Post"),
    "STUDY_AT": ("Person_studyAt_University",),
    "WORK_AT": ("Person_workAt_Company",),
}


def read_lsqb(spark: SparkSession, folder: str, *, node_path: str = "{}.csv", edge_path: str = "{}.csv") -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of all files of the folder; the paths say where in it the file of a name lies."""
    no_props = F.create_map().cast("map<string,string>").alias("props")

    def rows(path: str, columns: str) -> DataFrame:
        return spark.read.schema(columns).option("sep", "|").option("header", True).option("enforceSchema", True).csv(f"{folder}/{path}")

    nodes = [rows(node_path.format(kind), "id string").select(F.concat(F.lit(f"{kind}_"), "id").alias("id"), F.array(*[F.lit(x) for x in labels]).alias("labels"), no_props) for kind, labels in NODE_FILES.items()]
    edges = []
    for kind, files in EDGE_FILES.items():
        for name in files:
            source, _, target = name.split("_")[:3]
            edges.append(rows(edge_path.format(name), "src string, dst string").select(F.concat(F.lit(f"{source}_"), "src").alias("src"), F.lit(kind).alias("label"), F.concat(F.lit(f"{target}_"), "dst").alias("dst"), no_props))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
