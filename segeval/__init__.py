"""Measure how well automatic text-quality metrics agree with human raters.

Everything is a DataFrame-to-DataFrame function over keyed tables:

* ``segeval.sources``   - readers and writers (CSV, JDBC, score files, judge results)
* ``segeval.functions`` - column expressions (tokenisers, stemmer, edit distance, score parsing)
* ``segeval.operators`` - joins, rater filters, metrics, correlations, ranking, training tables
* ``segeval.plans``     - whole workflows built from the operators
"""
