"""Web-content readiness analytics and corpus preparation on PySpark."""
