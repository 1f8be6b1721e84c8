"""lumenbase: a Spark-first engine for document and timetable question answering."""
