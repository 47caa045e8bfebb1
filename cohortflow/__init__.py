"""cohortflow: entity-event cohort analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions) and names the columns it works on through parameters,
so the same operators run on clinical tables, order tables or any other
entity / event / child-record layout.
"""

__version__ = "0.1.0"
