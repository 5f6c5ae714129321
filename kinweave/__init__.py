"""Entity resolution and bi-temporal graph maintenance as Spark DataFrame operators."""
