"""strophe: corpus analytics for collections of line-structured texts on Spark."""
