"""Entity analytics on Spark: extraction, scoring, resolution, outreach selection and engagement."""
