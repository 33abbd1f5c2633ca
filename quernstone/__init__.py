"""quernstone: an event, incident and indicator analytics engine on PySpark."""

__version__ = "0.1.0"
