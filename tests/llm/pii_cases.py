"""Sentences with labelled mentions that no training text holds: names, streets and wordings of their own."""

import re

MARKED = """
When you arrive, {name:Lena Park} is waiting at the front gate.
Yesterday evening {name:Tomasz Wierzba} fixed the leak in the importer.
We owe this patch to {name:Grace O'Malley} and {name:Hiro Tanaka}.
The keynote by {name:Fatima El-Amin} starts at ten.
Minutes taken by {name:Priya Raman}, approved by {name:Joel Steinberg}.
{name:Carlos Mendoza}: I can reproduce it on my machine.
This was first noticed by {name:Ingrid Solberg} in March.
Could {name:Dmitri Volkov} look at the failing job?
Reviewed-by: {name:Amelia Hartley} <{email:amelia.hartley@example.org}>
The badge of {name:Noor Jansen} stopped working.
Hello {name:Beatriz Souza}, the order is on its way.
Speak to {name:R. Whitfield} if the door is locked.
Signed {name:Whitfield, Rosa}
{name:Marie-Claire Dubois} a signalé le défaut hier.
Herr {name:Jürgen Kessler} kommt heute später.
Die Karte von {name:Sabine Vogt} liegt am Empfang.
{name:KEVIN OYELARAN} REPORTED THE OUTAGE AT NOON.
as {name:maria lopez} said, the cache is stale
My landlord, {name:Peter Hallam}, has the spare key.
Nobody but {name:Yusuf Demir} has access to the vault.
The delivery goes to {address:14 Birchwood Lane}, second floor.
He moved from {address:221 Harcourt Street} to the coast.
Please return it to {address:7 Quarry Road, Bristol} by Friday.
{address:58 Elmfield Crescent, Leeds} is the new depot.
Unser Lager: {address:Lindenstraße 12, 80331 München}
Besuch am Montag in der {address:Rathausgasse 3, Linz}.
Rendez-vous au {address:25 rue Victor-Hugo, Lyon} demain.
The bill lists {address:9 Castle Hill} as the site.
Send samples to {address:301 Pinecrest Avenue} only.
The meter at {address:46 Tanner's Row} was read twice.
You can text {phone:+44 20 7946 0018} at any time.
My number is {phone:(312) 555-0147}, leave a message.
Fax went to {phone:030 9018 4455} by mistake.
Emergency line {phone:+33 1 99 00 27 61} is staffed all night.
ring {phone:415-555-0132} before you come
Please forward it to {email:j.novak@mailbox.example.net} today.
Backup contact is {email:support-anna@example.com}.
Use {email:ola [at] example [dot] org} for invoices.
reach me via {email:t_kimura@research.example.edu}, thanks
His passport number {id_number:K4829175} expired in June.
SSN {id_number:512-48-9036} must not appear in logs.
Social security number: {id_number:731-22-6408}
Personalnr. {id_number:4471902} wurde gelöscht.
Tax ID {id_number:83 204 117 965} is on the form.
The Copper Lantern service restarts every night.
Version 4.12.7 of the Silver Gate client is out.
Between 310 and 455 crates were moved to the North Wing.
Run make build-all and check port 8443.
Row 118-240-1177 of the report is empty.
Install @acme/tool-kit@2.4.1 first.
Clone git@code.example.net:team/site.git and build.
The Rapid Queue Worker and the Blue Cache were merged.
"""


def cases() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of every sentence."""
    out = []
    for line in MARKED.strip().split("\n"):
        text, spans = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            m = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else part
        out.append((text, spans))
    return out
