"""Licence scans: a trained paragraph classifier, and a comparison with templates that confirms it."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

# Sentences by which public licences are stated.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense"],
    "all-rights-reserved": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
OTHERS = [
    "The driving license was renewed at the office last week.", "Apache helicopters were seen over the valley.", "She studied at MIT before she moved to Geneva.", "Version 3 of the report was released under pressure.", "The general public was invited to the opening.",
    "He was granted a license to sell fish, free of charge.", "The work was published by the foundation in two volumes.", "Terms and conditions apply.", "This program is shown every evening.", "Permission to enter the site must be obtained at the gate.", "The software is distributed as a download.",
    "A copy of the letter is kept in the archive.", "Source code and binary forms are discussed in chapter two.", "Use of the library is free for members.", "The library may be modified next year.",
]


def tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+(?:[.+-][\\p{L}\\p{N}]+)*"), 0)


def features(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with `_f`: hashed words and word pairs of `_t`, of length 1."""
    # each array is bound to a variable of its own: as a column it would be computed anew for each element
    grams = F.transform(F.array("_t"), lambda t: F.concat(t, F.transform(F.filter(t, lambda x, i: i > 0), lambda x, i: F.concat_ws(" ", F.get(t, i), x))))
    rows = rows.withColumn("_g", F.get(grams, 0))
    rows = HashingTF(numFeatures=buckets, inputCol="_g", outputCol="_h").transform(rows)
    return Normalizer(inputCol="_h", outputCol="_f").transform(rows).drop("_g", "_h")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its place, from 0), _t (its tokens) of each line with a token; null texts have none."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "_line"))
    return rows.withColumn("_t", tokens(F.col("_line"))).where(F.size("_t") > 0).drop("_line")


class Model:
    """The classifier with its families, temperature and threshold.

    Every fifth of the stated sentences (by a hash of the sentence, with all forms cut from it) and of the negative lines is held back while the temperature and the threshold are set; with these fixed, the classifier is then fitted over all of them.
    """

    def __init__(self, docs: DataFrame, buckets: int, negatives: int, most_unknown: float):
        spark = docs.sparkSession
        self.families, self.buckets = ["none", *TEMPLATES], buckets
        rows = []
        for label, family in enumerate(self.families):
            for k, text in enumerate(OTHERS if family == "none" else TEMPLATES[family]):
                found = text.split()
                half = max(2, len(found) // 2)
                forms = {text, " ".join(found[:half]), "Note: " + text, text + " See the file for details."} if len(found) < 8 else {text, " ".join(found[:half]), " ".join(found[half:]), " ".join(found[len(found) // 4 : len(found) // 4 + half]), "Note: " + text}
                held = k == label % len(TEMPLATES.get(family, [0])) if family != "none" else k % 5 == 0
                rows += [(float(label), held, x) for x in sorted(forms if family != "none" else {text})] * (3 if family != "none" else 8)
        stated = spark.createDataFrame(rows, "label double, _held boolean, _x string").select("label", "_held", tokens(F.col("_x")).alias("_t"))
        # only the ids are ranked; the texts stay where they are
        few = keep(docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(negatives))
        lines = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi").where(F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("_x")).select(tokens(F.col("_x")).alias("_t")).where(F.size("_t") > 0)
        known = spark.createDataFrame([(t,) for ts in TEMPLATES.values() for t in ts], "_x string").agg(F.collect_list(F.array_distinct(tokens(F.col("_x")))).alias("_known"))
        like = F.exists("_known", lambda k: F.size(F.array_intersect(k, F.col("_t"))) >= 0.6 * F.size(k))  # a licence in other words is no negative
        lines = lines.crossJoin(F.broadcast(known)).where(~like).select(F.lit(0.0).alias("label"), (F.pmod(F.xxhash64("_t"), F.lit(5)) == 0).alias("_held"), "_t")
        both = keep(stated.union(lines))
        ready = features(both.coalesce(1), buckets)
        self.fitted = self._fit(ready.where("NOT _held"))
        held = keep(self.fitted.transform(ready.where("_held")).select("label", vector_to_array("_raw").alias("_z")))
        temperatures = F.explode(F.array(*[F.lit(0.25 * 1.15**k) for k in range(18)]))  # 0.25 to 2.7: few held-back sentences would flatten everything
        loss = held.withColumn("_temp", temperatures).groupBy("_temp").agg(F.avg(-F.log(F.element_at(self._soft(F.col("_z"), F.col("_temp")), (F.col("label") + 1).cast("int")) + 1e-12)).alias("loss"))
        best = loss.orderBy("loss", "_temp").first()
        self.temperature = best[0] if best else 1.0
        top = F.array_max(F.slice(self._soft(F.col("_z"), F.lit(self.temperature)), 2, len(TEMPLATES)))
        wrong = held.where("label = 0").agg(F.percentile(top, F.lit(1 - most_unknown))).first()[0]
        self.threshold = min(max(0.5, wrong or 0.0), 0.9)  # with few held-back lines their quantile says little
        self.fitted = self._fit(ready)

    @staticmethod
    def _fit(rows: DataFrame):
        return LogisticRegression(featuresCol="_f", labelCol="label", family="multinomial", maxIter=40, regParam=1e-4, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred").fit(rows)

    @staticmethod
    def _soft(z, temperature):
        e = F.transform(F.array(z), lambda v: F.transform(F.array(F.array_max(v)), lambda m: F.transform(v, lambda x: F.exp((x - m) / temperature)))[0])
        return F.transform(e, lambda v: F.transform(F.array(F.aggregate(v, F.lit(0.0), lambda a, y: a + y)), lambda n: F.transform(v, lambda x: x / n))[0])[0]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with family and probability, where it is not the unknown class."""
        raw = self.fitted.transform(features(rows, self.buckets)).drop("_f", "_prob")
        raw = raw.where("_pred > 0").withColumn("_p", self._soft(vector_to_array("_raw"), F.lit(self.temperature)))
        raw = raw.withColumn("probability", F.element_at("_p", (F.col("_pred") + 1).cast("int"))).where(F.col("probability") >= self.threshold)
        names = F.array(*[F.lit(x) for x in self.families])
        return raw.withColumn("family", F.element_at(names, (F.col("_pred") + 1).cast("int"))).drop("_raw", "_pred", "_p")


def scan(docs: DataFrame, buckets: int = 1 << 13, negatives: int = 400, most_unknown: float = 0.005, least_similar: float = 0.5) -> DataFrame:
    """doc_id, paragraph, family, probability, template, similarity, confirmed of each paragraph (line) that states a licence.

    The classifier is fitted on TEMPLATES, their parts, and the paragraphs of the first `negatives` documents by a hash of doc_id that share under 0.6 of the words of each; its probabilities are tempered on sentences and lines held back from a first fit, and a family
    counts from the probability that all but most_unknown of the held-back negatives stay under (from one half to 0.9). The family's template with the largest Jaccard similarity of words confirms it, from least_similar, or from 0.9 of the template's words found. Families that tie: the first of TEMPLATES; templates that tie: the last name.
    Null and empty texts and paragraphs without words give no row; repeated rows each give theirs; rows without a doc_id are scanned like any other; very long texts are read line by line, whole; an empty table gives an empty result.
    """
    model = Model(docs, buckets, negatives, most_unknown)
    found = model.predict(paragraphs(docs))
    stated = docs.sparkSession.createDataFrame([(f, f"{f}/{i}", t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)], "family string, template string, _x string")
    # a fixed table of some fifty rows
    stated = stated.groupBy("family").agg(F.collect_list(F.struct("template", F.array_distinct(tokens(F.col("_x"))).alias("t"))).alias("_all"))
    found = found.join(F.broadcast(stated), "family").withColumn("_t", F.array_distinct("_t"))
    best = F.array_max(F.transform("_all", lambda a: F.struct(
        (F.size(F.array_intersect(a["t"], F.col("_t"))) / F.size(F.array_union(a["t"], F.col("_t")))).alias("similarity"), (F.size(F.array_intersect(a["t"], F.col("_t"))) / F.size(a["t"])).alias("inside"), a["template"].alias("template"))))
    found = found.withColumn("_b", best)
    return found.select("doc_id", "paragraph", "family", "probability", "_b.template", "_b.similarity", ((F.col("_b.similarity") >= least_similar) | (F.col("_b.inside") >= 0.9)).alias("confirmed"))
